"""Operator 8: information-theoretic removal of personal data, with DataFrame functions only.

Four patterns find the protected entities.  A term is a word that lies outside of
them, anywhere in a document.  Of N documents n_e hold entity e, n_t hold term t and
n_et both.  With p(e) = n_e / N, the entity's information is IC(e) = -log2 p(e); from

    p(e | t) = (n_et + smooth * p(e)) / (n_t + smooth)

the term tells PMI(e; t) = log2(p(e | t) / p(e)) of it and leaves IC - PMI bits,
-log2 p(e | t), open.  A term that leaves at most ``left`` bits, and tells at least
``told``, gives the entity away: all its occurrences are added to the spans, in
documents that don't name the entity too.  Entities are generalised to their kind, such terms removed.

Entities that lie in the same documents are one class, and so are such terms, so
that pairs are counted for classes, not for each entity with each word.  Work on a
text is in proportion to its length (times a logarithm), however many spans it has.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.text import let
from catalith.llm.common import written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"

# The patterns find what the plain ones named beside them find.  Possessive
# repeats and the anchors (not within a run, or where the last match ended) keep
# long runs from being tried anew at each of their characters.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that every text with a match passes.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{10,}[0-9]", "phone": r"\+[0-9]"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SPAN = "struct<start:int,end:int,value:string>"
#: Rows that are broadcast, at most; more are joined by a shuffle.
SMALL = 400_000
#: Characters that are cut from a text at once; pieces are taken from these cuts.
CUT = 512
#: What stands for a document in joins: two hashes of its id and text, as ids may be null or repeated.
KEY = ["k1", "k2"]


@dataclass(frozen=True)
class Disclosure:
    """``left`` and ``told`` in bits; ``smooth`` counts so many more documents with the
    term, in which the entity is as frequent as anywhere; ``words`` finds the terms.

    As set here p(e | t) must reach 0.8, at any size of the corpus: a word that one
    document alone has, beside an entity, just does; a word that documents without
    the entity have too must be beside it in five of six.
    """

    left: float = math.log2(1 / 0.8)
    told: float = 1.0
    smooth: float = 0.25
    words: str = r"[\p{L}\p{M}\p{N}_]+"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    turned = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return match.isNotNull()
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    count = F.length(digits(match))
    if kind == "phone":
        return count.between(9, 15)
    return F.when((F.length(match) >= 12) & count.between(12, 19), passes_luhn(digits(match))).otherwise(F.lit(False))


def running(values: Column, n: Column, join) -> Column:
    """The running ``join`` (a sum, a maximum) of ``n`` integers from 0 up, by doubling steps."""
    steps = F.filter(F.expr("transform(sequence(0, 30), i -> shiftleft(1, i))"), lambda p: p < n)
    shifted = lambda acc, p: F.concat(F.array_repeat(F.lit(0), p), F.slice(acc, F.lit(1), n - p))
    return F.aggregate(steps, values, lambda acc, p: F.zip_with(acc, shifted(acc, p), join))


def located(text: Column, pattern: str, keep) -> Column:
    """The matches of ``pattern`` that pass ``keep``, with their places: what lies between matches tells where they are."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def place(found: Column) -> Column:
        n = F.size(found)
        sizes = F.zip_with(F.slice(gaps, F.lit(1), n), found, lambda g, m: F.length(g) + F.length(m))
        spans = lambda ends: F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))
        return F.filter(spans(running(sizes, n, lambda a, b: a + b)), lambda s: F.coalesce(keep(s["value"]), F.lit(False)))

    none = F.array().cast(f"array<{SPAN}>")
    return let(found, lambda m: F.when(F.size(m) > 0, place(m)).otherwise(none))


def base_spans(text: Column) -> Column:
    """All valid matches in order of start, then of kind as listed: structs (start, kind, end, value)."""

    def of_kind(i: int, kind: str) -> Column:
        none = F.array().cast(f"array<{SPAN}>")
        found = F.when(text.rlike(HINTS[kind]), located(text, PATTERNS[kind], lambda m: valid(kind, m))).otherwise(none)
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    return F.array_sort(F.concat(*[of_kind(i, k) for i, k in enumerate(KINDS)]))


def named(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def entity(span: Column) -> Column:
    value = F.when(span["kind"] >= 2, digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"].cast("string"), F.lit(":"), value)


def piece(cuts: Column, a: Column, b: Column) -> Column:
    """The characters from a to b, of a text in cuts of CUT characters."""
    i, j = ((a - a % CUT) / CUT).cast("int"), ((b - 1 - (b - 1) % CUT) / CUT).cast("int")
    ends = F.concat(F.substring(F.get(cuts, i), a % CUT + 1, F.lit(CUT)), F.array_join(F.slice(cuts, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.get(cuts, j), F.lit(1), b - j * CUT))
    return F.when(a >= b, "").when(i == j, F.substring(F.get(cuts, i), a % CUT + 1, b - a)).otherwise(ends)


def replaced(text: Column, spans: Column, mark) -> Column:
    """The text with each stretch of overlapping ``spans`` (in order of start) replaced.

    ``mark(span, fresh, grown)`` is put in for each span: whether it begins a stretch, and
    by how many characters it makes it longer.
    """

    def build(cuts: Column, spans: Column, reach: Column) -> Column:
        before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))

        def one(s: Column, i: Column) -> Column:
            fresh = s["start"] >= before(i)
            grown = F.get(reach, i) - F.greatest(s["start"], before(i))
            return F.concat(F.when(fresh, piece(cuts, before(i), s["start"])).otherwise(""), mark(s, fresh, grown))

        return F.concat(F.array_join(F.transform(spans, one), ""), piece(cuts, F.element_at(reach, -1), F.length(text)))

    ends = lambda spans: running(F.transform(spans, lambda s: s["end"]), F.size(spans), lambda a, b: F.greatest(a, b))
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CUT}}}"), F.lit(0))
    changed = let(F.struct(cut.alias("cuts"), spans.alias("spans")), lambda x: let(ends(x["spans"]), lambda reach: build(x["cuts"], x["spans"], reach)))
    return F.when(F.size(spans) > 0, changed).otherwise(text)


def blanked(text: Column, spans: Column) -> Column:
    """The text with line feeds in place of its entities, so that the rest keeps its places."""
    return replaced(text, spans, lambda s, fresh, grown: F.repeat(F.lit("\n"), grown))


def redacted(text: Column, spans: Column) -> Column:
    """The text with entities replaced by their kind and disclosing terms taken out."""
    marks = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS], F.lit(""))
    return replaced(text, spans, lambda s, fresh, grown: F.when(fresh, F.element_at(marks, s["kind"] + 1)).otherwise(""))


def terms_of(text: Column, words: str) -> Column:
    """Distinct words, each in lower case by itself: two letters' lower case depends on what follows or is longer."""
    found = lambda text: F.regexp_extract_all(text, F.lit(words), F.lit(0))
    alone = text.contains("\u03a3") | text.contains("\u0130")
    return F.array_distinct(F.when(alone, F.transform(found(text), lambda w: F.lower(w))).otherwise(found(F.lower(text))))


def key_of(doc_id: Column, text: Column) -> list[Column]:
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(1), text, doc_id).alias("k2")]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and key of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", "text", *key_of(F.col("doc_id"), F.col("text")))


def analysed(docs: DataFrame, how: Disclosure) -> DataFrame:
    """doc_id, key, base spans and distinct terms of each row; written, so that texts are cut into words once."""
    rows = keyed(docs).withColumn("base", base_spans(F.col("text"))).withColumn("apart", blanked(F.col("text"), F.col("base")))
    return written(rows.select("doc_id", *KEY, "base", terms_of(F.col("apart"), how.words).alias("terms")), "pii-base")


def small(df: DataFrame, rows: int) -> DataFrame:
    """To be broadcast if ``rows``, a checked size, allows it."""
    return F.broadcast(df) if rows <= SMALL else df


def alike() -> list[Column]:
    """Two hashes of the documents of a group with one row for each: what lies in the same documents has the same ones."""
    return [F.bit_xor(F.xxhash64(F.lit(seed), *KEY)).alias(f"h{seed}") for seed in (1, 2)]


def disclosing(rows: DataFrame, how: Disclosure) -> tuple[DataFrame, DataFrame] | None:
    """(term, elsewhere) of terms that give an entity away; elsewhere: also in rows without any entity.

    With them (term, key) of rows with an entity, for all of these terms and more.
    """
    held = rows.where(F.size("base") > 0)
    held = held.select(*KEY, F.array_distinct(F.transform("base", entity)).alias("entities"), "terms")
    held = written(held.groupBy(*KEY).agg(F.count("*").alias("rows"), F.any_value("entities").alias("entities"), F.any_value("terms").alias("terms")), "pii-held")
    total = rows.count()
    # p(e | t) can't exceed (n_held + smooth) / (n_t + smooth), so commoner words go first
    reach = round(2.0**-how.left, 12)
    beside = F.count_if(F.size("base") > 0)
    words = rows.select(F.explode("terms").alias("term"), "base").groupBy("term").agg(F.count("*").alias("n_t"), beside.alias("n_held"))
    words = words.where((F.col("n_held") > 0) & (F.col("n_held") + how.smooth >= reach * (F.col("n_t") + how.smooth)))
    words = written(words, "pii-words")
    n = words.count()
    if not n:
        return None
    places = held.select(*KEY, F.explode("terms").alias("term")).join(small(words, n), "term")
    places = written(places.select("term", "n_t", *KEY), "pii-places")
    terms = written(places.groupBy("term", "n_t").agg(*alike()), "pii-terms")
    named_places = held.select(*KEY, "rows", F.explode("entities").alias("entity"))
    entities = written(named_places.groupBy("entity").agg(F.sum("rows").alias("n_e"), *alike()), "pii-entities")

    e_class = named_places.join(entities, "entity").select(*KEY, "rows", "n_e", F.col("h1").alias("e1"), F.col("h2").alias("e2")).distinct()
    t_class = places.select("term", *KEY).join(terms, "term").select(*KEY, "n_t", F.col("h1").alias("t1"), F.col("h2").alias("t2")).distinct()
    pairs = e_class.join(t_class, KEY).groupBy("n_e", "e1", "e2", "n_t", "t1", "t2").agg(F.sum("rows").alias("n_et"))
    usual = F.col("n_e") / F.lit(float(total))
    given = (F.col("n_et") + how.smooth * usual) / (F.col("n_t") + how.smooth)
    found = pairs.where((given >= reach) & (given >= 2.0**how.told * usual)).select("n_t", F.col("t1").alias("h1"), F.col("t2").alias("h2")).distinct()
    reveal = terms.join(found, ["n_t", "h1", "h2"]).select("term").join(words, "term")
    return written(reveal.select("term", (F.col("n_t") > F.col("n_held")).alias("elsewhere")), "pii-disclosing"), places


def likely(terms: DataFrame, n: int) -> Callable[[Column], Column]:
    """A test that all of ``n`` terms pass and few other words, by a bit for each slot of a hash.

    The bits, seven in a byte, are a literal.  The driver prints a literal in every
    version of a plan, in hexadecimals, so it has 150 kB at most.
    """
    slots = 1 << min(20, max(10, (16 * n).bit_length()))
    slot = lambda term: F.pmod(F.xxhash64(term), F.lit(slots)).cast("int")
    taken = bytearray(-(-slots // 7))
    for i in terms.select(slot(F.col("term")).alias("slot")).distinct().toArrow().column("slot").to_pylist():
        taken[i // 7] |= 1 << i % 7
    byte = lambda i: F.ascii(F.substring(F.lit(bytes(taken)), ((i - i % 7) / 7).cast("int") + 1, F.lit(1)).cast("string"))
    return lambda term: F.getbit(byte(slot(term)), slot(term) % 7) == 1


def added_spans(docs: DataFrame, rows: DataFrame, how: Disclosure) -> DataFrame | None:
    """For each key the spans of terms that give an entity away (column ``added``); written."""
    reveal, places = disclosing(rows, how) or (None, None)
    n = reveal.count() if reveal is not None else 0
    if not n:
        return None
    hits = places.join(small(reveal.select("term"), n), "term", "left_semi").select(*KEY)
    other = reveal.where("elsewhere").select("term")
    if m := other.count():
        words = rows.where(F.size("base") == 0).select(*KEY, F.explode(F.filter("terms", likely(other, m))).alias("term"))
        hits = hits.unionByName(words.join(small(other, m), "term", "left_semi").select(*KEY))
    hits = written(hits.distinct(), "pii-hits")
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # texts cost time, whatever their bytes
    texts = keyed(docs).join(small(hits, hits.count()), KEY, "left_semi").repartition(parts, *KEY).dropDuplicates(KEY)
    words = texts.withColumn("base", base_spans(F.col("text"))).select(*KEY, located(blanked(F.col("text"), F.col("base")), how.words, lambda w: w.isNotNull()).alias("words"))
    words = words.select(*KEY, F.explode("words").alias("w")).select(*KEY, "w.start", "w.end", F.lower("w.value").alias("term"))
    span = F.struct("start", F.lit(len(KINDS)).alias("kind"), "end", F.lit("").alias("value"))
    found = words.join(small(reveal.select("term"), n), "term", "left_semi").groupBy(*KEY).agg(F.collect_list(span).alias("added"))
    return written(found, "pii-added")


def with_all_spans(rows: DataFrame, added: DataFrame | None) -> DataFrame:
    """Add ``spans``, base and added ones, to rows with key and ``base``."""
    if added is None:
        return rows.withColumn("spans", F.col("base"))
    n = added.agg(F.sum(F.size("added"))).first()[0] or 0
    rows = rows.join(small(added, n), KEY, "left")
    return rows.withColumn("spans", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))).drop("added")


def find_personal_data(docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """One row per row of ``docs``: counts by kind, the digest of the base spans, all spans.

    Offsets are code points, ends exclusive.  Null texts are empty and have no
    spans; an empty table gives no rows; rows with the same id and text get the same
    spans; repeated rows count as documents of their own; further columns are ignored.
    """
    rows = analysed(docs, how)
    out = with_all_spans(rows.drop("terms"), added_spans(docs, rows, how))
    n = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return out.select("doc_id", *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def without_personal_data(docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """The rows of ``docs`` with personal data and disclosing terms taken out of the texts.

    Rows without any keep their text; null texts stay null; ``n_chars``, if there,
    is the new length.  Of overlapping spans the first counts, its mark standing for
    all.  Columns of any name pass through: the row travels as one struct.
    """
    added = added_spans(docs, analysed(docs, how), how)
    row, text = F.col("row"), F.coalesce(F.col("row.text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select("row", *key_of(F.col("row.doc_id").cast("long"), text), base_spans(text).alias("base"))
    rows = with_all_spans(rows, added).select("row", F.when(F.size("spans") > 0, redacted(text, F.col("spans"))).otherwise(F.col("row.text")).alias("new"))
    changed = {"text": F.col("new").alias("text"), "n_chars": F.coalesce(F.length("new").cast("long"), row["n_chars"]).alias("n_chars") if "n_chars" in docs.columns else None}
    return rows.select(*[changed.get(c) if changed.get(c) is not None else row[c].alias(c) for c in docs.columns])
