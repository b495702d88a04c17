"""Text, array and map functions as Column expressions, and texts made of tables; all of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.interactions import by_user

_WHITE_ENDS = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _WHITE_ENDS, "")


def non_blank(parts: Column) -> Column:
    """Trimmed entries of an array of strings, without blank and null ones."""
    return F.filter(F.transform(parts, strip), lambda x: x.isNotNull() & (x != ""))


def normalize_title(c: Column) -> Column:
    """Lower case, the last parenthesis dropped, a trailing article moved behind the comma's place, single spaces."""
    bare = strip(F.regexp_replace(strip(F.lower(c)), r"\([^(]*\)$", ""))
    return strip(F.regexp_replace(F.regexp_replace(bare, r", (the|an|a)$", r" $1"), r"(?U)\s+", " "))


def clean_title_legacy(c: Column) -> Column:
    """The older key: cut at the first parenthesis, then ", the", ", a" and ", an" dropped anywhere, in this order."""
    cut = strip(F.substring_index(F.lower(F.coalesce(c, F.lit(""))), "(", 1))
    for article in (", the", ", a", ", an"):
        cut = F.replace(cut, F.lit(article), F.lit(""))
    return strip(cut)


#: Phrases that stand for a genre wherever they occur (fixed values).
GENRE_ALIASES = {"science fiction": "Sci-Fi", "scifi": "Sci-Fi", "sci fi": "Sci-Fi"}


def genres_from_text(text: Column, vocabulary: Column) -> Column:
    """Sorted genres of the vocabulary that the text names as whole words or by an alias."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def named(g: Column) -> Column:
        quoted = F.concat(F.lit(r"(?U)(?<!\w)"), F.regexp_replace(F.lower(g), r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(r"(?!\w)"))
        by_alias = F.lit(False)
        for phrase, genre in GENRE_ALIASES.items():
            by_alias = by_alias | ((g == genre) & low.contains(phrase))
        return F.regexp_like(low, quoted) | by_alias

    return F.array_sort(F.filter(vocabulary, named))


def genres_of_literal(text: Column, vocabulary: list[str]) -> Column:
    """As genres_from_text for a vocabulary known when the plan is made: plain conditions that compile."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = []
    for g in sorted(set(vocabulary)):
        hit = low.rlike(r"(?U)(?<!\w)" + re.sub(r"([^\w\s])", r"\\\1", g.lower()) + r"(?!\w)")
        for phrase, genre in GENRE_ALIASES.items():
            if genre == g:
                hit = hit | low.contains(phrase)
        found.append(F.when(hit, F.lit(g)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def preference_text(parts: Column) -> Column:
    return F.array_join(non_blank(parts), "\nContext: ")


# The sentences are fixed values.
def genre_summary(genres: Column, context: Column) -> Column:
    own = F.array_distinct(non_blank(genres))
    base = F.when(F.size(own) > 0, F.concat(F.lit("The user prefers movies in these genres: "), F.array_join(own, ", "), F.lit("."))).otherwise("")
    return preference_text(F.array(base, context))


# The sentences are fixed values.
def taste_summary(liked: Column, disliked: Column, context: Column) -> Column:
    """The deterministic fallback of a taste summary."""
    parts = F.array(
        F.concat(F.lit("The user likes movies such as "), F.array_join(liked, ", "), F.lit(".")),
        F.when(F.size(disliked) > 0, F.concat(F.lit("The user does not enjoy "), F.array_join(disliked, ", "), F.lit("."))),
        F.when(strip(context) != "", F.concat(F.lit("Current viewing context: "), strip(context))),
    )
    return F.when(F.size(liked) > 0, F.array_join(F.array_compact(parts), " ")).otherwise("")


# The sentences are fixed values.
def selection_summary(titles: Column, genres: Column) -> Column:
    """Summary of chosen movies: their titles in order, their genres by first appearance; empty without titles."""
    text = F.concat(F.lit("The user likes movies such as "), F.array_join(titles, ", "), F.lit(". Their selected movies suggest interest in "), F.array_join(F.array_distinct(genres), ", "), F.lit("."))
    return F.when(F.size(titles) > 0, text).otherwise("")


# The sentences are fixed values.
def interface_summary(genres: Column, context: Column) -> Column:
    """The default summary that a front end shows before a service answers."""
    own = F.array_distinct(genres)
    named = F.when(F.size(own) > 0, F.array_join(own, ", ")).otherwise("character-driven cinema")
    extra = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(" Their current viewing context is: "), context, F.lit("."))).otherwise("")
    return F.concat(
        F.lit("Summary: The user enjoys "), named, F.lit(" movies. They seem to enjoy plot points and storytelling patterns shared by their selected films."), extra,
        F.lit(" No additional disliked genres can be inferred beyond those entered in the exclusion field. No disliked plot points that other users may enjoy can be inferred from the current selections."),
    )


# The sentences are fixed values.
def selected_taste(titles: Column, context: Column) -> Column:
    some = F.coalesce(context, F.lit("")) != ""
    listed = F.concat(F.lit("User likes: "), F.array_join(titles, ", "), F.when(some, F.concat(F.lit("\nContext: "), context)).otherwise(""))
    return F.when(F.size(titles) > 0, listed).when(some, F.concat(F.lit("Context: "), context)).otherwise("")


def ordered_union(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(a, b))


#: What in a text (in lower case) means that a genre is disliked (fixed values).
DISLIKE_RULES = {
    "Horror": "dislike.*horror|no horror|hate horror",
    "Comedy": "dislike.*comedy|no comedy|hate comedy",
    "Drama": "dislike.*drama|no drama",
    "Thriller": "dislike.*thriller",
    "Action": "dislike.*action",
}


def extract_dislikes(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(rule), F.lit(g)) for g, rule in DISLIKE_RULES.items()]))


def search_title(title: Column) -> Column:
    """A title cleaned for a search service."""
    out = F.regexp_replace(title, r"\(.*?\)", "")
    for pattern, new in ((r"[:,]", ""), (r"\.", ""), (r"\s+-\s+.*", ""), (r"  +", " ")):
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


def episode(title: Column) -> Column:
    found = F.regexp_extract(title, r"(?i)Episode\s+([IVX]+)", 1)
    return F.when(found != "", found)


def search_queries(title: Column) -> Column:
    """What a search service is asked, one after the other."""
    return F.array_compact(F.array(search_title(title), title, F.concat(F.lit("Star Wars Episode "), episode(title)), F.when(title.contains("-"), F.trim(F.substring_index(title, "-", 1)))))


#: Ids of genre names in the movie database's scheme (fixed values).
GENRE_IDS = {
    "Action": 28, "Adventure": 12, "Animation": 16, "Comedy": 35, "Crime": 80, "Documentary": 99, "Drama": 18, "Family": 10751, "Fantasy": 14, "History": 36, "Horror": 27, "Music": 10402,
    "Mystery": 9648, "Romance": 10749, "Science Fiction": 878, "Sci-Fi": 878, "Sci Fi": 878, "SciFi": 878, "Thriller": 53, "War": 10752, "Western": 37, "TV Movie": 10770,
}


def normalize_genre(c: Column) -> Column:
    """Hyphens as spaces; the first "science fiction" and then the first "sci fi" are put in one spelling."""

    def first(text: Column, pattern: str, new: str) -> Column:
        return F.regexp_replace(text, f"(?is)^(.*?){pattern}", f"$1{new}")

    out = first(F.replace(c, F.lit("-"), F.lit(" ")), "science fiction", "Science Fiction")
    return F.trim(first(out, "sci fi", "Sci-Fi"))


def genre_ids(genres: Column) -> Column:
    """Ids of the genres that have one, in order."""
    table = F.create_map(*[F.lit(x) for pair in GENRE_IDS.items() for x in pair])
    return F.filter(F.transform(genres, lambda g: F.try_element_at(table, g)), lambda x: x.isNotNull())


def canonical_genre(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("-"), F.lit(" "))


def short_overview(text: Column) -> Column:
    two = F.concat(F.array_join(F.slice(F.split(text, r"\."), 1, 2), "."), F.lit("."))
    return F.when(F.coalesce(text, F.lit("")) != "", strip(two)).otherwise("")


def comma_list(text: Column) -> Column:
    return non_blank(F.split(F.coalesce(text, F.lit("")), ","))


def year_of(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


def generated_list(text: Column, top_k: int) -> Column:
    """Entries of a generated list: at commas and line ends, longer than one character."""
    parts = F.transform(F.split(F.replace(text, F.lit("\n"), F.lit(",")), ","), strip)
    return F.slice(F.filter(parts, lambda x: F.length(x) > 1), 1, top_k)


def favourite_genres(text: Column) -> tuple[Column, Column]:
    """The genres named on the first two lines after ": "; null where the form differs."""
    lines = F.split(text, "\n")

    def value(k: int) -> Column:
        return canonical_genre(F.get(F.split(F.get(lines, F.lit(k)), ": "), F.lit(1)))

    return value(0), value(1)


def rank_change(before: Column, now: Column) -> Column:
    d = before - now
    return F.when(d > 0, F.concat(F.lit("⬆ +"), d.cast("string"))).when(d < 0, F.concat(F.lit("⬇ "), d.cast("string"))).when(d == 0, "–")


def describe_histories(history: DataFrame, catalog: DataFrame, genres: int = 5, titles: int = 12) -> DataFrame:
    """user_id and description: a user's most frequent genres and evenly spaced titles of its items (user_id, item_index).

    Genres are ordered by count, then by name; titles by item, all of them where the user has no more than titles.
    """
    owned = by_user(history.join(catalog.select("item_index", "genres"), "item_index").select("user_id", "genres"))
    counts = owned.select("user_id", F.explode("genres").alias("genre")).groupBy("user_id", "genre").agg(F.count("*").alias("n"))
    few = counts.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "genre"))).where(F.col("k") <= genres)
    named = few.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", "genre")))["genre"], ", ").alias("genres"))
    placed = by_user(history).withColumns({"p": F.row_number().over(Window.partitionBy("user_id").orderBy("item_index")) - 1, "n": F.count("*").over(Window.partitionBy("user_id"))})
    spread = F.transform(F.sequence(F.lit(0), F.lit(titles - 1)), lambda i: F.floor(i * (F.col("n") - 1) / max(titles - 1, 1)))
    kept = placed.where((F.col("n") <= titles) | F.array_contains(spread, F.col("p").cast("long"))).join(catalog.select("item_index", "title"), "item_index")
    listed = kept.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("p", "title")))["title"], "; ").alias("titles"))
    text = F.concat(F.lit("The user enjoys "), "genres", F.lit(" movies. Movies they liked include: "), "titles", F.lit("."))
    return named.join(listed, "user_id").select("user_id", text.alias("description"))
