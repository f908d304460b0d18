"""Canonical names: dictionary and fuzzy lookups, consolidation, majority votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions import similarity, text
from catalith.functions import vocabulary as V


def best_candidate(queries: DataFrame, candidates: DataFrame, threshold: float, block: Column | None = None) -> DataFrame:
    """(q, c, score): the best candidate of each query string, ties to the smaller one.

    Both sides hold distinct strings.  Lengths that can't reach the threshold aren't
    compared: candidates are met by length, an equi-join over the lengths a query
    allows, not by a cross join.
    """
    n = F.length("q")
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(n * threshold / (200.0 - threshold)).cast("int")), F.greatest(F.lit(1), F.floor(n * (200.0 - threshold) / threshold).cast("int")))
    q = queries.where(n > 0).select("q", F.explode(lengths).alias("len"))
    c = candidates.select("c", F.length("c").alias("len"))
    scored = q.join(c, "len").withColumn("score", similarity.ratio_from(F.col("q"), F.col("c"), threshold)).where(F.col("score") >= threshold)
    best = scored.groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("s"), "c")).alias("b"))
    return best.select("q", F.col("b.c").alias("c"), (-F.col("b.s")).alias("score"))


def best_match(queries: DataFrame, candidates: DataFrame, threshold: float = V.FUZZY_DEFAULT, most: int = 100_000) -> DataFrame:
    """(q, c, score): the candidate with the best of the three scores, normalised first; ties to the smaller one.

    A short string may lie anywhere in a long one, so lengths rule nothing out: each
    distinct query meets each distinct candidate.  Candidates are a dictionary, of
    ``most`` entries at most, which is checked.
    """
    c = candidates.select("c").distinct()
    if c.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} candidates")
    scored = queries.select("q").distinct().join(F.broadcast(c)).withColumn("score", similarity.best_of(F.col("q"), F.col("c")))
    best = scored.where(F.col("score") >= threshold).groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("s"), "c")).alias("b"))
    return best.select("q", F.col("b.c").alias("c"), (-F.col("b.s")).alias("score"))


def canon_artists(df: DataFrame, canon: DataFrame, column: str = "artist", threshold: float = V.ARTIST_CANON) -> DataFrame:
    """Distinct names with their canonical form: by the dictionary, else by likeness, else unchanged."""
    names = df.where(F.coalesce(column, F.lit("")) != "").select(F.col(column).alias("raw")).distinct().withColumn("key", text.canon_key(F.col("raw")))
    known = canon.where(F.coalesce("canonical", F.lit("")) != "").select(F.col("raw").alias("canon_key"), "canonical")
    exact = names.join(known, names["key"] == known["canon_key"], "left")
    rest = exact.where("canonical is null").select(F.col("key").alias("q")).distinct()
    near = best_candidate(rest, known.select(F.col("canon_key").alias("c")), threshold).join(known.select(F.col("canon_key").alias("c"), F.col("canonical").alias("near")), "c")
    out = exact.join(near.select("q", "near"), exact["key"] == near["q"], "left")
    how = F.when(F.col("canonical").isNotNull(), "exact").when(F.col("near").isNotNull(), "fuzzy").otherwise("none")
    return out.select("raw", F.coalesce("canonical", "near", "raw").alias("canonical"), how.alias("source"))


def canon_genres(df: DataFrame, allowed: DataFrame, mapped: DataFrame, column: str = "genre", threshold: float = V.GENRE_CANON) -> DataFrame:
    """Distinct genres with their canonical form: allow-list, then map, then likeness, else null."""
    names = df.where(F.coalesce(column, F.lit("")) != "").select(F.col(column).alias("raw")).distinct().withColumn("key", F.lower(text.stripped(F.col("raw"))))
    a = allowed.groupBy(F.lower("genre").alias("a_key")).agg(F.min("genre").alias("allowed"))
    m = mapped.select(F.lower("raw").alias("m_key"), F.col("canonical").alias("mapped")).where(F.coalesce("mapped", F.lit("")) != "")
    out = names.join(a, names["key"] == a["a_key"], "left").join(m, names["key"] == m["m_key"], "left")
    rest = out.where("allowed is null and mapped is null").select(F.col("key").alias("q")).distinct()
    near = best_candidate(rest, a.select(F.col("a_key").alias("c")), threshold).join(a.select(F.col("a_key").alias("c"), F.col("allowed").alias("near")), "c")
    out = out.join(near.select("q", "near"), out["key"] == near["q"], "left")
    how = F.when(F.col("allowed").isNotNull(), "allowed").when(F.col("mapped").isNotNull(), "mapped").when(F.col("near").isNotNull(), "fuzzy").otherwise("none")
    return out.select("raw", F.coalesce("allowed", "mapped", "near").alias("canonical"), how.alias("source"))


def consolidated(df: DataFrame, column: str = "artist") -> DataFrame:
    """(old, new) for spellings of one artist that differ from the preferred one.

    Known display names win; where spellings with and without article meet, the
    commonest one without it gets ``, The``; else the commonest, then the longest.
    """
    counts = df.where((F.col("status") == "CATALOGUED") & (F.trim(column) != "")).groupBy(F.col(column).alias("old")).agg(F.count("*").alias("n"))
    rows = counts.withColumns({"key": text.consolidation_key(F.col("old")), "clean": text.without_guests(F.col("old"))}).where(F.col("clean") != "")
    rows = rows.withColumn("article", text.has_article(F.col("clean")))
    rank = F.struct((-F.col("n")).alias("n"), (-F.length("clean")).alias("l"), F.lower("clean").alias("low"), F.col("clean").alias("name"))
    groups = rows.groupBy("key").agg(F.count("*").alias("spellings"), F.min(rank).alias("best"), F.min(F.when(~F.col("article"), rank)).alias("bare"), F.bool_or("article").alias("some"))
    known = F.create_map(*[F.lit(x) for kv in V.DISPLAY_NAMES.items() for x in kv])
    with_article = F.concat(text.display_title(F.col("bare.name")), F.lit(", The"))
    chosen = F.coalesce(known[F.col("key")], F.when(F.col("some") & F.col("bare").isNotNull(), with_article).otherwise(text.display_title(F.col("best.name"))))
    groups = groups.where("spellings > 1").select("key", chosen.alias("new"))
    return rows.join(groups, "key").where("old <> new").select("old", "new", "n")


def majority_fill(df: DataFrame, group: str = "artist", value: str = "genre") -> DataFrame:
    """Rows without a value, with the commonest value of their group; ties to the smaller value."""
    key = F.lower(text.stripped(F.col(group)))
    filled = df.where((F.trim(group) != "") & (F.trim(value) != "")).groupBy(key.alias("key"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    best = filled.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("b")).select("key", F.col("b.v").alias("new_value"))
    return df.where(text.blank(F.col(value)) & (F.trim(group) != "")).withColumn("key", key).join(best, "key").select("file_path", "new_value")


def first_match(df: DataFrame, candidates: DataFrame, path: str = "path") -> DataFrame:
    """For each row the first candidate with the same artist and title, by path."""
    key = [F.lower(F.trim("artist")).alias("_a"), F.lower(F.trim("title")).alias("_t")]
    best = candidates.select(*key, path).groupBy("_a", "_t").agg(F.min(path).alias("match"))
    return df.select("*", *key).join(best, ["_a", "_t"]).drop("_a", "_t")


def album_variants(df: DataFrame) -> DataFrame:
    """Albums of an artist that differ in case or spaces, with the longest spelling."""
    rows = df.where((F.trim("artist") != "") & (F.trim("album") != ""))
    rows = rows.groupBy("artist", "album").agg(F.min("file_path").alias("sample"))
    key = F.lower(F.trim("album"))
    groups = rows.groupBy("artist", key.alias("key")).agg(F.count("*").alias("spellings"), F.max(F.struct(F.length("album").alias("l"), "album")).alias("b")).where("spellings > 1")
    return rows.withColumn("key", key).join(groups, ["artist", "key"]).where(F.col("album") != F.col("b.album")).select("artist", "album", F.col("b.album").alias("canonical"), "sample")
