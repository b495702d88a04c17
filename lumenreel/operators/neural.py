"""Hooks for neural models: encoders of text, dense encoder-decoders over profiles, a registry by name.

Models are trained elsewhere and come as arrays. They run in Arrow batches of users with their weights sent once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .. import folders
from ..shipping import ship
from . import interactions
from .itemside import whole_partition
from .ranking import DIGITS, best_of_rows

CELLS = 4_000_000  # of users by items that a task holds at once
WIDE = 1024  # items of a block
USERS = 4096  # scored by a task

Layer = tuple[np.ndarray, np.ndarray]


def swish(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"tanh": np.tanh, "swish": swish, "relu": lambda x: np.maximum(x, 0), "none": lambda x: x}


@dataclass
class EncoderDecoder:
    """A denoising or variational autoencoder at inference: the mean of the latent, then logits of all items.

    latent: size of the mean; a wider last encoder layer holds the log variance behind it. normalize scales profiles to
    length 1 first. film: scale and shift of the hidden layer by a condition vector (weights of either, with biases).
    """

    encoder: list[Layer]
    decoder: list[Layer]
    latent: int
    activation: str = "tanh"
    normalize: bool = True
    film: tuple[Layer, Layer] | None = None

    def encode(self, x: np.ndarray, condition: np.ndarray | None = None) -> np.ndarray:
        if self.normalize:
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        act = ACTIVATIONS[self.activation]
        for k, (w, b) in enumerate(self.encoder):
            x = x @ w + b
            if k < len(self.encoder) - 1:
                x = act(x)
                if self.film is not None and condition is not None and k == 0:
                    (gw, gb), (bw, bb) = self.film
                    x = (condition @ gw + gb) * x + condition @ bw + bb
        return x[:, : self.latent]

    def decode(self, z: np.ndarray) -> np.ndarray:
        act = ACTIVATIONS[self.activation]
        for k, (w, b) in enumerate(self.decoder):
            z = z @ w + b
            if k < len(self.decoder) - 1:
                z = act(z)
        return z

    def logits(self, x: np.ndarray, text: np.ndarray | None = None, alpha: float = 1.0, negative: bool = False, condition: np.ndarray | None = None) -> np.ndarray:
        """Logits of profiles; with latents of texts, of the merged ones; with conditions, of the steered ones."""
        z = self.encode(x, condition)
        if text is not None:
            z = (z - text) / 2 if negative else (1 - alpha) * text + alpha * z
        return self.decode(z)


@dataclass
class SkipEncoderDecoder:
    """A variational autoencoder at inference whose encoder sums its layers: a hidden layer is the swish of its product
    plus all earlier layers' outputs, scaled to mean 0 and variance 1, with its own gain and shift."""

    hidden: list[Layer]
    norms: list[Layer]  # gain and shift of each hidden layer
    mean: Layer
    decoder: Layer
    eps: float = 0.1

    def encode(self, x: np.ndarray) -> np.ndarray:
        last = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        total = 0.0
        for (w, b), (gain, shift) in zip(self.hidden, self.norms, strict=True):
            h = swish(last @ w + b + total)
            h = h - h.mean(axis=1, keepdims=True)
            last = h / np.sqrt((h * h).mean(axis=1, keepdims=True) + self.eps) * gain + shift
            total = total + last
        return last @ self.mean[0] + self.mean[1]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.encode(x) @ self.decoder[0] + self.decoder[1]


@dataclass
class SoftmaxHead:
    """A linear layer from text vectors to items; its scores are softmax logits."""

    weight: np.ndarray  # size x items
    bias: np.ndarray

    def logits(self, x: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
        return text @ self.weight + self.bias


def fit_head(vectors: np.ndarray, profiles: np.ndarray, epochs: int = 20, batch: int = 256, rate: float = 1e-3, decay: float = 1e-4, seed: int = 0) -> SoftmaxHead:
    """Fits a head to profiles (rows of 0 and 1, taken as shares) by the multinomial loss with decoupled weight decay.

    For a bounded sample of users that the driver holds; scoring by score_users() covers all.
    """
    rng = np.random.default_rng(seed)
    shares = profiles / np.maximum(profiles.sum(axis=1, keepdims=True), 1.0)
    edge = vectors.shape[1] ** -0.5
    values = [rng.uniform(-edge, edge, (vectors.shape[1], profiles.shape[1])), rng.uniform(-edge, edge, profiles.shape[1])]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(epochs):
        order = rng.permutation(len(vectors))
        for at in range(0, len(order), batch):
            x, y = vectors[order[at : at + batch]], shares[order[at : at + batch]]
            z = x @ values[0] + values[1]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (p * y.sum(axis=1, keepdims=True) - y) / len(x)
            step += 1
            for i, g in enumerate((x.T @ error, error.sum(axis=0))):
                first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
                move = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                values[i] = values[i] * (1 - rate * decay) - rate * move
    return SoftmaxHead(*values)


@dataclass
class TextClassifier:
    """A text-only classifier: a text's vector through dense layers, tanh between them, to logits of the items."""

    layers: list[Layer]

    def logits(self, x: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
        return dense(text, self.layers)


@dataclass
class TextBlend:
    """A text's vector through dense layers to the latent's mean, gamma of it and the rest of the ratings' mean."""

    layers: list[Layer]
    model: EncoderDecoder
    gamma: float = 0.5

    def logits(self, x: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
        own = dense(text, self.layers)[:, : self.model.latent]
        return self.model.decode(self.gamma * own + (1 - self.gamma) * self.model.encode(x))


def dense(x: np.ndarray, layers: list[Layer]) -> np.ndarray:
    for k, (w, b) in enumerate(layers):
        x = x @ w + b
        if k < len(layers) - 1:
            x = np.tanh(x)
    return x


@dataclass
class Prototypes:
    """A disentangled autoencoder at inference: items belong to factors, each factor is coded on its own, and the
    factors' probabilities are mixed by the items' shares. Routing repeats as often as rounds says.

    With latents of texts (those of the factors in a row, each scaled to length 1) a factor's code is merged with its
    text's: (1 - alpha) of the text's and alpha of its own, or half their difference if negative.
    """

    items: np.ndarray  # items x size
    cores: np.ndarray  # factors x size
    model: EncoderDecoder
    temperature: float = 0.1
    rounds: int = 4

    def shares(self) -> np.ndarray:
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        cores = unit(self.cores)
        for _ in range(self.rounds):
            s = np.exp(unit(self.items) @ cores.T / self.temperature)
            s /= s.sum(axis=1, keepdims=True)
            cores = unit(s.T @ unit(self.items))
        return s

    def logits(self, x: np.ndarray, text: np.ndarray | None = None, alpha: float = 1.0, negative: bool = False) -> np.ndarray:
        shares = self.shares()
        if text is not None:
            text = text.reshape(len(x), shares.shape[1], -1)
            text = text / np.maximum(np.linalg.norm(text, axis=2, keepdims=True), 1e-12)
        unit = self.items / np.maximum(np.linalg.norm(self.items, axis=1, keepdims=True), 1e-12)
        total = np.zeros(x.shape)
        for k in range(shares.shape[1]):
            z = self.model.encode(x * shares[:, k])
            z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            if text is not None:
                z = (z - text[:, k]) / 2 if negative else (1 - alpha) * text[:, k] + alpha * z
                z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            total += np.exp(z @ unit.T / self.temperature) * shares[:, k]
        return np.log(np.maximum(total, 1e-300))


#: Makers of models by name; callers add theirs.
REGISTRY: dict[str, Callable[..., object]] = {"dae": EncoderDecoder, "vae": EncoderDecoder, "recvae": SkipEncoderDecoder, "head": SoftmaxHead, "film_vae": EncoderDecoder, "macrid": Prototypes, "text": TextClassifier, "text_blend": TextBlend}


def make(name: str, **arguments):
    if name not in REGISTRY:
        raise KeyError(f"no model is registered as {name}; known are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**arguments)


def score_users(history: DataFrame, model, items: np.ndarray, k: int = 10, vectors: DataFrame | None = None, as_: str = "text", **how) -> DataFrame:
    """user_id, rank, item_index and score of the k best unseen items by a model's logits.

    vectors (user_id, vector) go to the model with each user's profile, as its argument as_ (text latents or
    conditions); users without one have no list then. how: more arguments of the model's logits. For models that a
    worker can hold; score_blocks() is for larger ones.
    """
    ship(history.sparkSession)
    sent, steered = history.sparkSession.sparkContext.broadcast((model, items)), vectors is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, own = sent.value
        most = max(1, min(256, CELLS // max(len(own), 1)))
        for batch in batches:
            for at in range(0, len(batch), most):
                part = batch.iloc[at : at + most]
                x = np.zeros((len(part), len(own)))
                for row, seen in enumerate(part["items"]):
                    x[row, np.searchsorted(own, np.asarray(seen))] = 1
                more = {as_: np.stack(part["vector"].to_list())} if steered else {}
                scores = np.round(m.logits(x, **more, **how), DIGITS)
                scores[x > 0] = -np.inf
                for user, (cols, best) in zip(part.user_id, best_of_rows(scores, k), strict=True):
                    yield pd.DataFrame({"user_id": user, "rank": np.arange(1, len(cols) + 1, dtype=np.int32), "item_index": own[cols], "score": best})

    profiles = history.groupBy("user_id").agg(F.collect_list("item_index").alias("items"))  # of one user
    if steered:
        profiles = profiles.join(vectors.select("user_id", "vector").where("vector IS NOT NULL"), "user_id")
    return profiles.mapInPandas(run, "user_id long, rank int, item_index long, score double")


@dataclass
class Blocks:
    """An encoder-decoder whose first and last layer are files of the shared folder, one for each WIDE items.

    A file has items (ascending over the files), first (their rows of the first layer), last and bias (their columns of
    the last). inner has the layers between, with the first layer's bias, and takes the sum of a profile's rows.
    """

    inner: EncoderDecoder
    files: list[str]
    places: DataFrame  # item_index and place
    folder: str
    normalize: bool = True


def write_blocks(items: DataFrame, inner: EncoderDecoder, first: Callable[[int], np.ndarray], last: Iterator[np.ndarray], normalize: bool = True) -> Blocks:
    """Blocks of the different items (item_index) in ascending order, from a model that comes piece by piece.

    first(n) gives the first layer's next n rows, last the last layer's rows (a value for each item) and then its bias.
    They are written as they come, so the driver holds a row of the last layer at most; a task a block lays them together.
    """
    spark = items.sparkSession
    ship(spark)
    places = folders.stored(interactions.dense_ids(items, "item_index", "place"), "places")
    n, folder = places.count(), folders.new(spark, "blocks")
    blocks = -(-n // WIDE)
    rows = [folders.write_bytes(folder, np.ascontiguousarray(first(min(WIDE, n - at)), "<f8").data) for at in range(0, n, WIDE)]
    planes = [folders.write_bytes(folder, np.ascontiguousarray(row, "<f8").data) for row in last]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = whole_partition(batches)
        if own is not None:
            own = own.sort_values("place")
            at, size = int(own.place.iloc[0]), len(own)
            top = np.frombuffer(folders.read_range(rows[at // wide], 0, size * height * 8), "<f8").reshape(size, height)
            low = np.stack([np.frombuffer(folders.read_range(p, at * 8, size * 8), "<f8") for p in planes])
            path = folders.write_arrays(folder, items=own.item_index.to_numpy(np.int64), first=top, last=low[:-1], bias=low[-1])
            yield pd.DataFrame({"block": [at // wide], "path": [path]})

    wide, height = WIDE, len(inner.encoder[0][1])
    found = {}
    if n:
        dealt = places.withColumn("block", F.floor(F.col("place") / wide).cast("int")).repartitionById(blocks, "block").drop("block")
        found = {r.block: r.path for r in dealt.mapInPandas(write, "block int, path string").collect()}  # a row for each block
    for path in (*rows, *planes):
        folders.delete(spark, path)
    return Blocks(inner, [found[j] for j in range(blocks)], places, folder, normalize)


def score_blocks(history: DataFrame, model: Blocks, k: int = 10) -> DataFrame:
    """user_id, rank, item_index and score of the k best unseen items, as score_users(), by blocks of items.

    A task holds its users' hidden values and the k best so far; a block's logits are looked through for those above the
    k-th. Logits are made only of items that can be above some user's: by lengths within the few axes along which hidden
    values lie, and apart from these. Models whose hidden values lie along all axes pass over no item.
    """
    files, inner, normalize, wide = model.files, model.inner, model.normalize, WIDE

    def answered(users: np.ndarray, profiles: list[np.ndarray]) -> pd.DataFrame:
        size = np.array([len(p) for p in profiles])
        owner, place = np.repeat(np.arange(len(profiles)), size), np.concatenate(profiles)
        by = np.argsort(place, kind="stable")
        owner, place = owner[by], place[by]
        cuts = np.searchsorted(place, np.arange(len(files) + 1) * wide)
        x = np.zeros((len(profiles), len(inner.encoder[0][1])))
        for j, path in enumerate(files):
            here = slice(cuts[j], cuts[j + 1])
            if cuts[j] < cuts[j + 1]:
                np.add.at(x, owner[here], folders.read_arrays(path)["first"][place[here] - j * wide])
        if normalize:
            x /= np.sqrt(size)[:, None]
        z = inner.decode(inner.encode(x))
        best, found = np.full((len(profiles), k), -np.inf), np.zeros((len(profiles), k), np.int64)
        energy, axes = np.linalg.eigh(z.T @ z)
        main = energy > 1e-8 * energy[-1]
        near_z, far_z = (np.linalg.norm(z @ axes[:, m], axis=1) for m in (main, ~main))
        some = near_z.min() > 0
        slope, ends = (np.max(far_z / near_z), 1 / np.array([[near_z.min()], [near_z.max()]])) if some else (0.0, np.ones((2, 1)))
        for j, path in enumerate(files):
            block, here = folders.read_arrays(path), slice(cuts[j], cuts[j + 1])
            last, bias, own, at = block["last"], block["bias"], owner[here], place[here] - j * wide
            items = np.arange(len(bias))
            least = np.min((best[:, -1] - 10.0**-DIGITS) / near_z) if some else -np.inf
            if np.isfinite(least):
                turned = axes.T @ last
                most = np.linalg.norm(turned[main], axis=0) + slope * np.linalg.norm(turned[~main], axis=0) + (bias * ends).max(axis=0)
                items = np.flatnonzero(most + 1e-9 * np.abs(most) >= least)
                if not len(items):
                    continue
                last, bias = last[:, items], bias[items]
                col = np.minimum(np.searchsorted(items, at), len(items) - 1)
                seen = items[col] == at
                own, at = own[seen], col[seen]
            scores = z @ last
            scores += bias
            scores[own, at] = -np.inf
            rows = np.flatnonzero(scores.max(axis=1) > best[:, -1] - 10.0**-DIGITS)
            if not len(rows):
                continue
            near = best_of_rows(np.round(scores[rows], DIGITS), k)
            new, cols = np.full((len(rows), k), -np.inf), np.zeros((len(rows), k), np.int64)
            for row, (c, s) in enumerate(near):
                new[row, : len(c)], cols[row, : len(c)] = s, c
            # Items ascend over the blocks, so in a stable order ties go to the smaller one.
            both, ids = np.hstack([best[rows], new]), np.hstack([found[rows], block["items"][items[cols]]])
            order = np.argsort(-both, axis=1, kind="stable")[:, :k]
            best[rows], found[rows] = np.take_along_axis(both, order, axis=1), np.take_along_axis(ids, order, axis=1)
        fine = np.isfinite(best)
        rank = np.tile(np.arange(1, k + 1, dtype=np.int32), (len(profiles), 1))
        return pd.DataFrame({"user_id": np.repeat(users, fine.sum(axis=1)), "rank": rank[fine], "item_index": found[fine], "score": best[fine]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), USERS):
                part = batch.iloc[at : at + USERS]
                yield answered(part.user_id.to_numpy(), [np.asarray(p, np.int64) for p in part["places"]])

    own = history.join(model.places, "item_index").groupBy("user_id").agg(F.sort_array(F.collect_set("place")).alias("places"))  # of one user
    own = folders.stored(own, "profiles")
    return own.repartition(max(1, -(-own.count() // USERS)), "user_id").mapInPandas(run, "user_id long, rank int, item_index long, score double")


def text_encoder(encode: Callable[[list[str]], np.ndarray]):
    """A column function of texts made of an encoder of lists; blank and null texts have no vector."""

    @pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        some = texts.fillna("").str.strip() != ""
        out = pd.Series([None] * len(texts), dtype=object)
        if some.any():
            vectors = np.asarray(encode(texts[some].tolist()), dtype=np.float32)
            vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            for i, v in zip(np.flatnonzero(some), vectors, strict=True):
                out.iat[i] = v
        return out

    return run


def mean_pooled(encode: Callable[[list[str]], list[np.ndarray]], limit: int = 256) -> Callable[[list[str]], np.ndarray]:
    """An encoder of texts for text_encoder(), of one that gives each text's token vectors: the mean of the first limit."""
    return lambda texts: np.stack([np.asarray(tokens, dtype=np.float64)[:limit].mean(axis=0) for tokens in encode(texts)])
