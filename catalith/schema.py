"""Table schemas and readers that mend text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


TABLES: dict[str, str] = {
    "archive": (
        "id long, file_path string not null, audio_hash string, full_hash string, filename string, ext string, size_bytes long, artist string, album string, title string, genre string, year string, track int, duration double, bitrate long, sample_rate long, channels int, codec string, "
        "status string, date_added timestamp, last_seen timestamp, last_modified timestamp, lufs double, lufs_tp double, rg_gain double, rg_peak double, rg_tagged_at timestamp, canonicalized_at timestamp, canon_action string, finalized_at timestamp, lufs_baked_at timestamp, lufs_baked_target double, bpm double, musical_key string, energy double, danceability double, bpm_analyzed_at timestamp"
    ),
    "events": "seq long, ts timestamp, run_id string, event_type string, file_path string, old_value string, new_value string, stage string, note string",
    "duplicates": "group_id string, file_path string, duplicate_type string, confidence double, run_id string, status string",
    "validation_issues": "file_path string, issue string, severity string, run_id string",
    "metadata_cache": "file_path string, raw_json string",
    "baseline": "path string, sha256 string, size_bytes long",
    "ledger": "audio_hash string, file_path string",
    "review": "file_path string, field_name string, current_value string, new_value string, source string, confidence double, reason string, approve string",
}


def table_schema(name: str) -> StructType:
    """The schema of a table; needs a running session."""
    return StructType.fromDDL(TABLES[name])


def mended(df: DataFrame) -> DataFrame:
    """Blank texts become null, so that "not set" has one form."""
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    return df.withColumns({c: F.when(F.trim(c) != "", F.col(c)) for c in texts})


def parsed_time(column: str):
    """Timestamps in either of the two textual forms."""
    return F.coalesce(F.try_to_timestamp(F.col(column), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.col(column), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
