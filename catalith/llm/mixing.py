"""Operator 2: mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key.  A source's documents are dealt into
ranges of the key; sums by range and their running sums are the distributed
prefix sums, and only the one range in which a source's budget ends is sorted
row by row.  No task ever holds a whole source, and texts never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import WORD, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Leading hexadecimal digits of the key that name its range.
RANGE_DIGITS = 4


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def random_key(doc_id: Column, seed: int) -> Column:
    """32 hexadecimal digits that depend on the document and the seed only."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The target of each source, from one row (source, source_size) for each.

    Sources in code point order, null last, take the weights in turn and share
    ``share`` of all sizes by weight; none gets more than ``max_epochs`` times its
    size, and the excess is shared among the others.  Sorted by cap / weight, the
    capped sources come first, so one pass of running sums finds the level at
    which the others stand.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    listed = sizes.withColumn("place", F.row_number().over(order) - 1)
    listed = listed.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    listed = listed.withColumn("cap", max_epochs * F.col("source_size"))
    by_level = Window.orderBy((F.col("cap") / F.col("weight")), "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    listed = listed.withColumns(
        {
            "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "pool": F.sum("source_size").over(whole) * F.lit(float(share)),
            "weights": F.sum("weight").over(whole),
        }
    )
    listed = listed.withColumn("level", (F.col("pool") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
    listed = listed.withColumns({"capped": F.col("cap") / F.col("weight") <= F.col("level"), "water": F.max("level").over(whole)})
    return listed.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("water") * F.col("weight")).alias("target"))


def sized_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """One narrow row for each document, written once: the texts are read only here."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words_of(F.col("text")).alias("size"), random_key(F.col("doc_id"), seed).alias("key"))
    return written(rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS)), "mix-sizes")


def cuts(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """For each source its target, its full passes, and the range in which the last pass ends; written."""
    sums = written(sized.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    totals = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, max_epochs)
    budget = F.round("target").cast("long")
    size = F.col("source_size")
    totals = totals.withColumn("passes", F.when(size > 0, F.floor(budget / size)).otherwise(0).cast("long"))
    totals = totals.withColumn("rest", F.when(size > 0, budget - F.col("passes") * size).otherwise(0))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("range_start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    t, s = totals.alias("t"), sums.alias("s")
    hit = F.col("t.source").eqNullSafe(F.col("s.source")) & (F.col("s.range_start") < F.col("t.rest")) & (F.col("t.rest") <= F.col("s.range_start") + F.col("s.range_size"))
    found = t.join(s, hit, "left")
    found = found.select("t.source", "t.source_size", "t.target", "t.passes", "t.rest", F.col("s.range").alias("cut_range"), F.col("s.range_start").alias("cut_start"))
    return written(found, "mix-cuts")


def allotted(sized: DataFrame, cut: DataFrame) -> DataFrame:
    """Words that the mix takes of each document; the last pass ends exactly at the budget."""
    # documents meet their plan by source and range, so a hot source is spread over its ranges
    ranges, c = sized.select("source", "range").distinct().alias("r"), cut.alias("c")
    plan = ranges.join(c, F.col("r.source").eqNullSafe(F.col("c.source"))).select("r.source", "r.range", "c.source_size", "c.target", "c.passes", "c.rest", "c.cut_range", "c.cut_start")
    d, p = sized.alias("d"), plan.alias("p")
    joined = d.join(p, F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.range") == F.col("p.range")))
    joined = joined.select("d.doc_id", "d.source", "d.size", "d.key", "d.range", "p.source_size", "p.target", "p.passes", "p.rest", "p.cut_range", "p.cut_start")
    at_cut = F.coalesce(F.col("range") == F.col("cut_range"), F.lit(False))
    before = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = joined.where(at_cut).withColumn("start", F.col("cut_start") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    inside = inside.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))).drop("start")
    outside = joined.where(~at_cut).withColumn("extra", F.when(F.col("range") < F.col("cut_range"), F.col("size")).otherwise(F.lit(0)))
    return inside.unionByName(outside).withColumn("taken", (F.col("passes") * F.col("size") + F.col("extra")).cast("long"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 0, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    A source smaller than its target is repeated in whole passes and then in part.
    Null texts have size 0; a null source is a source of its own; of rows with the
    same doc_id the shorter comes first; an empty table gives no rows.  Further
    columns of ``docs`` are ignored.
    """
    sized = sized_documents(docs, seed)
    return allotted(sized, cuts(sized, weights, share, max_epochs)).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 0, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of ``docs`` themselves, whole and repeated as the mix takes them.

    A document at the end of the budget stays whole if at least half of it lies
    within.  The cut is one key for each source, so the texts pass through without
    a shuffle: a document's copies follow from its own key.
    """
    sized = sized_documents(docs, seed)
    cut = cuts(sized, weights, share, max_epochs)
    taken = allotted(sized, cut).where((F.col("range") == F.col("cut_range")) & (2 * F.col("extra") >= F.col("size")) & (F.col("extra") > 0))
    last = taken.groupBy("source").agg(F.max("key").alias("last_key"))
    c, k = cut.alias("c"), last.alias("k")
    plan = c.join(k, F.col("c.source").eqNullSafe(F.col("k.source")), "left").select(F.col("c.source").alias("_source"), F.col("c.passes").alias("_passes"), F.coalesce("k.last_key", "c.cut_range").alias("_last"))
    plan = written(plan, "mix-plan")  # a table whose size is known: joined without moving the texts if it is small
    keyed = docs.withColumn("_key", random_key(F.col("doc_id"), seed))
    joined = keyed.join(plan, keyed["source"].eqNullSafe(plan["_source"]))
    copies = F.col("_passes") + F.when(F.col("_key") <= F.col("_last"), 1).otherwise(0)
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("_copy")).drop("_copy")
