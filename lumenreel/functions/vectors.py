"""Array-of-double functions: norms, cosine, fusion, latent merges, steering, and losses in closed form."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, not again for each element of an array that f goes over."""
    return F.element_at(F.transform(F.array(value), f), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def without_nan(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(F.isnan(x) | x.isNull(), F.lit(0.0)).otherwise(x.cast("double")))


def normalize(v: Column, eps: float = 1e-12) -> Column:
    """NaN as 0, then length 1; a vector without length stays."""
    return bound(without_nan(v), lambda clean: bound(F.greatest(norm(clean), F.lit(eps)), lambda n: F.transform(clean, lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mean(v: Column) -> Column:
    return bound(v, lambda w: F.try_divide(total(w), F.size(w).cast("double")))


def log_sum_exp(v: Column) -> Column:
    return bound(F.array_max(v), lambda top: F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top)


def log_softmax(v: Column) -> Column:
    return bound(log_sum_exp(v), lambda lse: F.transform(v, lambda x: x - lse))


def softmax(v: Column) -> Column:
    return F.transform(log_softmax(v), F.exp)


def fuse(summary: Column, context: Column, alpha: float = 0.75) -> Column:
    """alpha of the summary and the rest of the context, with length 1; the other one where one is null."""
    both = normalize(F.zip_with(summary, context, lambda s, c: F.lit(alpha) * s + F.lit(1 - alpha) * c))
    return F.when(summary.isNull(), context).when(context.isNull(), summary).otherwise(both)


def merge_latents(text: Column, rec: Column, alpha: float, negative: bool = False) -> Column:
    """(1 - alpha) of the text's and alpha of the ratings' vector; negative: half their difference."""
    return F.zip_with(text, rec, lambda t, r: (r - t) / 2 if negative else F.lit(1 - alpha) * t + F.lit(alpha) * r)


def steer(vector: Column, vocabulary: list[str], genre: Column, mode: str = "one_hot", favourite: Column | None = None) -> Column:
    """A genre vector moved towards a genre: "small" sets it to 1, "one_hot" leaves nothing else, "negative" sets it to
    0, "proportional" exchanges its value with the favourite's."""
    names = F.array(*map(F.lit, vocabulary))
    at = F.array_position(names, genre) - 1
    if mode == "proportional":
        fav = F.array_position(names, favourite) - 1
        return F.transform(vector, lambda x, i: F.when(i == at, F.get(vector, fav)).when(i == fav, F.get(vector, at)).otherwise(x))
    here, else_ = {"small": (1.0, None), "one_hot": (1.0, 0.0), "negative": (0.0, None)}[mode]
    return F.transform(vector, lambda x, i: F.when(i == at, F.lit(here)).otherwise(x if else_ is None else F.lit(else_)))


def pool(tokens: Column, how: str = "mean") -> Column:
    """Pools an array of token vectors: mean, weighted_mean (weights 1, 2, ...), last (also eos) or bos."""
    if how in ("last", "eos"):
        return F.element_at(tokens, -1)
    if how == "bos":
        return F.element_at(tokens, 1)
    weight = (lambda i: (i + 1).cast("double")) if how == "weighted_mean" else (lambda i: F.lit(1.0))
    weighted = F.transform(tokens, lambda v, i: F.transform(v, lambda x: x.cast("double") * weight(i)))
    n = F.size(tokens).cast("double")
    whole = n * (n + 1) / 2 if how == "weighted_mean" else n
    summed = F.reduce(F.slice(weighted, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), F.element_at(weighted, 1), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(summed, lambda x: x / whole)


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1; zeros where it is 0 throughout."""
    kept = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] > 0)
    zero = F.transform(F.element_at(tokens, 1), lambda x: F.lit(0.0))
    summed = F.aggregate(kept, zero, lambda a, x: F.zip_with(a, x["t"], lambda p, q: p + q.cast("double")))
    return F.transform(summed, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def bce_with_logits(logits: Column, labels: Column) -> Column:
    """Mean binary cross-entropy of logits."""
    each = F.zip_with(logits, labels, lambda x, y: F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x))))
    return mean(each)


def softmax_bce(logits: Column, labels: Column) -> Column:
    """Minus the mean of log-softmax times labels."""
    return -mean(F.zip_with(log_softmax(logits), labels, lambda a, b: a * b))


def kl_standard(mu: Column, logvar: Column) -> Column:
    """Mean divergence of diagonal Gaussians from the standard one."""
    return F.lit(-0.5) * mean(F.zip_with(mu, logvar, lambda m, v: F.lit(1.0) + v - m * m - F.exp(v)))


def kl_between(mu: Column, logvar: Column, prior_mu: Column, prior_logvar: Column) -> Column:
    """Sum divergence between diagonal Gaussians."""
    pairs = F.zip_with(F.arrays_zip(mu.alias("m"), logvar.alias("v")), F.arrays_zip(prior_mu.alias("m"), prior_logvar.alias("v")), lambda a, b: b["v"] - a["v"] + (F.exp(a["v"]) + (a["m"] - b["m"]) * (a["m"] - b["m"])) / F.exp(b["v"]) - 1)
    return F.lit(0.5) * total(pairs)


def js_between(mu: Column, logvar: Column, prior_mu: Column, prior_logvar: Column) -> Column:
    """Mean of the divergences from either Gaussian to the one in the middle."""
    half = lambda a, b: F.zip_with(a, b, lambda x, y: (x + y) / 2)
    m, v = half(mu, prior_mu), half(logvar, prior_logvar)
    return (kl_between(mu, logvar, m, v) + kl_between(prior_mu, prior_logvar, m, v)) / 2


def bures_wasserstein(mu: Column, var: Column, other_mu: Column, other_var: Column) -> Column:
    """Squared distance of diagonal Gaussians given by means and variances."""
    sq = lambda a, b, f: total(F.zip_with(a, b, lambda x, y: (f(x) - f(y)) * (f(x) - f(y))))
    return sq(mu, other_mu, lambda x: x) + sq(var, other_var, F.sqrt)


def log_normal(x: Column, mu: Column, logvar: Column) -> Column:
    """Sum of the log densities of diagonal Gaussians."""
    z = F.zip_with(F.zip_with(x, mu, lambda a, b: (a - b) * (a - b)), logvar, lambda d, v: F.lit(-0.5) * (v + F.lit(math.log(2 * math.pi)) + d / F.exp(v)))
    return total(z)


def composite_prior(z: Column, post_mu: Column, post_logvar: Column, weights: tuple[float, float, float] = (3 / 20, 3 / 4, 1 / 10)) -> Column:
    """Sum of the log densities of a mixture of a standard, an earlier posterior and a wide Gaussian (log variance 10)."""

    def density(x: Column, m: Column, v: Column, w: float) -> Column:
        return F.lit(-0.5) * (v + F.lit(math.log(2 * math.pi)) + (x - m) * (x - m) / F.exp(v)) + F.lit(math.log(w))

    def mixed(x: Column, post: Column) -> Column:
        return log_sum_exp(F.array(density(x, F.lit(0.0), F.lit(0.0), weights[0]), density(x, post["m"], post["v"], weights[1]), density(x, F.lit(0.0), F.lit(10.0), weights[2])))

    return total(F.zip_with(z, F.arrays_zip(post_mu.alias("m"), post_logvar.alias("v")), mixed))


def composite_elbo(logits: Column, labels: Column, z: Column, mu: Column, logvar: Column, post_mu: Column, post_logvar: Column, weight: Column) -> Column:
    """Minus the evidence bound of a row: multinomial likelihood less weight times the divergence from the mixture."""
    likelihood = total(F.zip_with(log_softmax(logits), labels, lambda a, b: a * b))
    return weight * (log_normal(z, mu, logvar) - composite_prior(z, post_mu, post_logvar)) - likelihood


def temperature_kl(logits: Column, target_logits: Column, temperature: float = 1.0) -> Column:
    """Divergence of the softened target from the softened logits, times the squared temperature."""
    soft = lambda v: F.transform(v, lambda x: x / temperature)
    pairs = F.zip_with(log_softmax(soft(target_logits)), log_softmax(soft(logits)), lambda t, p: F.exp(t) * (t - p))
    return total(pairs) * F.lit(temperature * temperature)


def spread_kl(logvar: Column) -> Column:
    """kl_standard() without the means."""
    return F.lit(-0.5) * mean(F.transform(logvar, lambda v: F.lit(1.0) + v - F.exp(v)))


def three_way_bce(merged: Column, text: Column, rec: Column, labels: Column, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    """A third of the weighted sum of softmax_bce() of the merged, the text's and the ratings' logits."""
    return sum((softmax_bce(x, labels) * w for x, w in zip((merged, text, rec), weights, strict=True)), F.lit(0.0)) / 3


def _variance(logvar: Column) -> Column:
    return F.transform(logvar, F.exp)


def prior_bce(merged: Column, text: Column, rec: Column, labels: Column, mu: Column, logvar: Column, prior_mu: Column, prior_logvar: Column, anneal: float = 1.0, epsilon: float = 1.0, how: str = "none") -> Column:
    """three_way_bce() and half the annealed divergences of both Gaussians from the standard one; how "ot" adds epsilon
    times their distance."""
    loss = three_way_bce(merged, text, rec, labels) + (kl_standard(mu, logvar) + kl_standard(prior_mu, prior_logvar)) * (anneal / 2)
    if how == "none":
        return loss
    if how != "ot":
        raise ValueError("how is none or ot")
    return loss + bures_wasserstein(mu, _variance(logvar), prior_mu, _variance(prior_logvar)) * epsilon


def disentangled_loss(merged: Column, text: Column, rec: Column, labels: Column, mu: Column, logvar: Column, prior_mu: Column, prior_logvar: Column, how: str = "ot", weights: tuple[float, float, float] = (1.0, 1.0, 1.0), anneal: float = 1.0, epsilon: float = 1.0) -> Column:
    """three_way_bce() with a regularizer between the text's and the ratings' Gaussians.

    "none", "ot" (squared distance) and "js" (divergence from the middle, in variances) have half the annealed
    spread_kl() of both; "kl" has the divergence itself, half annealed and epsilon times.
    """
    loss = three_way_bce(merged, text, rec, labels, weights)
    if how == "kl":
        return loss + kl_between(mu, logvar, prior_mu, prior_logvar) * (anneal / 2 + epsilon)
    loss = loss + (spread_kl(logvar) + spread_kl(prior_logvar)) * (anneal / 2)
    if how == "none":
        return loss
    var, prior_var = _variance(logvar), _variance(prior_logvar)
    if how == "js":
        return loss + js_of_variances(mu, var, prior_mu, prior_var) * epsilon
    if how != "ot":
        raise ValueError("how is none, ot, js or kl")
    return loss + bures_wasserstein(mu, var, prior_mu, prior_var) * epsilon


def js_of_variances(mu: Column, var: Column, prior_mu: Column, prior_var: Column) -> Column:
    """Mean of the divergences from either Gaussian to the one of the mean means and the mean variances."""
    half = lambda a, b: F.zip_with(a, b, lambda x, y: (x + y) / 2)
    log = lambda v: F.transform(v, lambda x: F.log(x))
    m, v = half(mu, prior_mu), log(half(var, prior_var))
    return (kl_between(mu, log(var), m, v) + kl_between(prior_mu, log(prior_var), m, v)) / 2


def contrastive(rows: DataFrame, by: str = "batch") -> DataFrame:
    """by and contrastive: the loss of each batch of rows (mu, logvar, prior_mu, prior_logvar; arrays).

    A Gaussian is its means and variances in one vector. A row's own pair is held, by the cosine, against the pairs of
    its prior with all rows of the batch. A batch is as long as a training step, so it is one list.
    """
    unit = lambda m, v: normalize(F.concat(F.transform(m, lambda x: x.cast("double")), _variance(v)))
    pairs = rows.select(by, F.struct(unit(F.col("mu"), F.col("logvar")).alias("e"), unit(F.col("prior_mu"), F.col("prior_logvar")).alias("p")).alias("r"))
    lists = pairs.groupBy(by).agg(F.collect_list("r").alias("l"))
    against = lambda r: F.log(F.aggregate("l", F.lit(0.0), lambda s, x: s + F.exp(dot(x["e"], r["p"]))))
    return lists.select(by, (-mean(F.transform("l", lambda r: dot(r["e"], r["p"]) - against(r)))).alias("contrastive"))


def contrastive_loss(rows: DataFrame, by: str = "batch", weights: tuple[float, float, float] = (1.0, 1.0, 1.0), epsilon: float = 1.0) -> DataFrame:
    """by and loss of each batch: a third of the weighted softmax_bce() of all three logits, of epsilon times the
    contrastive loss and of both Gaussians' spread_kl(). rows: as contrastive(), with merged, text, rec and labels."""
    own = three_way_bce(F.col("merged"), F.col("text"), F.col("rec"), F.col("labels"), weights) * 3 + spread_kl(F.col("logvar")) + spread_kl(F.col("prior_logvar"))
    means = rows.groupBy(by).agg(F.avg(own).alias("own"))
    return means.join(contrastive(rows, by), by).select(by, ((F.col("own") + F.col("contrastive") * epsilon) / 3).alias("loss"))


#: Losses by name: of a row, but for the two that take rows of batches.
LOSSES = {
    "bce": bce_with_logits, "softmax_bce": softmax_bce, "kl": kl_standard, "kl_between": kl_between, "js": js_between, "ot": bures_wasserstein, "log_normal": log_normal, "temperature_kl": temperature_kl, "composite_elbo": composite_elbo,
    "prior_bce": prior_bce, "disentangled": disentangled_loss, "contrastive": contrastive, "contrastive_loss": contrastive_loss,
}


def anneal(step: int, steps: int, most: float = 0.5) -> float:
    return min(most, step / steps)
