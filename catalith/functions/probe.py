"""Nested probe documents and tool output as flat columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENT = (
    "format struct<duration:string,bit_rate:string,tags:map<string,string>>,"
    "streams array<struct<codec_type:string,codec_name:string,sample_rate:string,channels:string,bit_rate:string,duration:string,tags:map<string,string>>>"
)


def _lower_keys(tags: Column) -> Column:
    """Later keys win where case folding makes two the same."""
    entries = F.transform(F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return entries


def _tag(entries: Column, *keys: str) -> Column:
    def one(key: str) -> Column:
        hits = F.filter(entries, lambda e: (e["key"] == key) & (F.coalesce(e["value"], F.lit("")) != ""))
        return F.trim(F.try_element_at(hits, F.lit(-1))["value"])

    return F.coalesce(*[one(k) for k in keys])


def _number(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")) != "", x).try_cast("double")


def flattened(df: DataFrame, raw: str = "raw_json") -> DataFrame:
    """Flat metadata of each document: first audio stream; format tags before stream tags.

    Duration comes from the format first, bit rate from the stream first; a document
    that can't be parsed gives nulls.
    """
    doc = df.withColumn("_d", F.from_json(raw, DOCUMENT))
    audio = F.get(F.filter(F.coalesce(F.col("_d.streams"), F.array().cast("array<" + DOCUMENT.split("array<", 1)[1])), lambda s: s["codec_type"] == "audio"), F.lit(0))
    doc = doc.withColumn("_a", audio)
    doc = doc.withColumn("_t", F.concat(_lower_keys(F.col("_a.tags")), _lower_keys(F.col("_d.format.tags"))))
    tags = F.col("_t")
    some = lambda *xs: F.coalesce(*[F.when(x != "", x) for x in xs])
    return doc.select(
        *[c for c in df.columns if c != raw],
        _tag(tags, "title").alias("title"),
        _tag(tags, "artist", "albumartist").alias("artist"),
        _tag(tags, "album").alias("album"),
        _tag(tags, "genre").alias("genre"),
        F.substring(_tag(tags, "date", "year", "originaldate"), 1, 4).alias("year"),
        F.trim(F.split_part(_tag(tags, "track", "tracknumber"), F.lit("/"), F.lit(1))).try_cast("int").alias("track"),
        _number(some(F.col("_d.format.duration"), F.col("_a.duration"))).alias("duration"),
        _number(some(F.col("_a.bit_rate"), F.col("_d.format.bit_rate"))).cast("long").alias("bitrate"),
        _number(F.col("_a.sample_rate")).cast("long").alias("sample_rate"),
        _number(F.col("_a.channels")).cast("int").alias("channels"),
        F.col("_a.codec_name").alias("codec"),
    )


def loudness_json(text: Column) -> Column:
    """The last JSON object of a tool's output that speaks of the input loudness."""
    objects = F.filter(F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda o: o.contains("input_i"))
    return F.from_json(F.try_element_at(objects, F.lit(-1)), "input_i string, input_tp string, input_lra string, input_thresh string")


def findings(text: Column) -> Column:
    """An array of review findings from a reply that may be fenced."""
    plain = F.trim(F.regexp_replace(text, r"(?s)^\s*```[a-z]*\s*|\s*```\s*$", ""))
    return F.from_json(plain, "array<struct<file_path:string,issue_type:string,detail:string,suggestion:string,confidence:double>>")


def valid_findings(df: DataFrame, text: str = "reply", least: float = 0.6) -> DataFrame:
    """One row for each finding with a path, a type and enough confidence."""
    rows = df.select(F.explode(findings(F.col(text))).alias("f")).select("f.*")
    rows = rows.where((F.coalesce("file_path", F.lit("")) != "") & (F.coalesce("issue_type", F.lit("")) != "") & (F.coalesce("confidence", F.lit(0.0)) >= least))
    return rows.select("file_path", F.substring("issue_type", 1, 40).alias("issue_type"), F.substring("detail", 1, 200).alias("detail"), F.substring("suggestion", 1, 200).alias("suggestion"), "confidence")
