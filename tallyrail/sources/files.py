"""Readers with explicit schemas. Fields that a reader doesn't know are ignored, but for settings, where they are errors."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SELECTION = "limitless array<struct<slug:string,end_epoch:bigint>>, polymarket array<struct<condition_id:string,clob_token_ids:array<string>,end_epoch:bigint>>"
TAPE = "t_ns bigint, venue string, stream string, family string, market string, events bigint, bytes bigint, handoff_ns bigint, generation bigint, text string"
#: Prices and quantities are quoted text, which JSON readers keep exactly; a bare number would pass through a double.
MESSAGE = "connection string, generation bigint, seq bigint, t_ns bigint, kind string, events array<struct<family:string,market:string,bids:array<struct<price:string,qty:string>>,asks:array<struct<price:string,qty:string>>>>"
REPORT = (
    "schema string, reason string, qualified boolean, window_seconds bigint, shards array<struct<shard:int,venue:string,stream:string,generation:bigint,connected:boolean,covered:bigint,"
    "required:bigint,received:bigint,decoded:bigint,faults:map<string,bigint>,controls:map<string,bigint>,families:array<struct<family:string,events:bigint,p50_ub_us:bigint,p99_ub_us:bigint,max_ns:bigint>>>>"
)
SETTINGS = {"markets", "metrics_listen", "markets_per_shard"}


class SettingsError(ValueError):
    """Settings that no run accepts; exit code 2."""

    code = 2


class NotInstalled(ValueError):
    """The segment doesn't hold the market; exit code 1."""

    code = 1


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SELECTION).json(path, multiLine=True)


def read_settings(text: str) -> dict:
    """Settings from TOML text; an unknown field is an error."""
    try:
        settings = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise SettingsError(str(error)) from error
    if unknown := settings.keys() - SETTINGS:
        raise SettingsError(f"unknown field {sorted(unknown)[0]}")
    if not 1 <= settings.get("markets_per_shard", 100):
        raise SettingsError("markets_per_shard must be positive")
    return {"markets": [], "markets_per_shard": 100, "metrics_listen": None} | settings


def check_flags(workers: int = 2, max_seconds: int = 3600, serve: bool = True, min_seconds: int = 900, min_events: int = 10_000) -> None:
    """Bounds of a run's flags."""
    if not 1 <= workers <= 8:
        raise SettingsError("workers must be from 1 to 8")
    if not 0 < max_seconds <= 14_400:
        raise SettingsError("max_seconds must be at most 14400")
    if not serve and (min_seconds < 900 or min_events < 10_000):
        raise SettingsError("a measurement needs 900 seconds and 10000 events at least")


def read_tape(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TAPE).json(path)


def stream_tape(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Tape files as they arrive; ``files`` a micro-batch bounds what a trigger reads."""
    return spark.readStream.schema(TAPE).option("maxFilesPerTrigger", files).json(path)


def parsed_messages(lines: DataFrame, line: str = "line") -> DataFrame:
    """The fields of one JSON object a line, for batch and stream alike, in place of the column ``line``; a malformed
    line has its text in ``malformed`` and nulls else."""
    parsed = F.from_json(F.col(line), MESSAGE + ", malformed string", {"columnNameOfCorruptRecord": "malformed"})
    return lines.withColumn("message_", parsed).select(*[c for c in lines.columns if c != line], "message_.*")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Captured messages, one JSON object a line."""
    return parsed_messages(spark.read.text(path), "value")


def decoded_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejected): one row per event of the valid messages with its place, and the malformed lines."""
    held = messages.withColumn("bad", F.col("malformed").isNotNull() | F.col("kind").isNull())
    events = held.filter(~F.col("bad")).select("connection", "generation", "seq", "t_ns", "kind", F.posexplode_outer("events").alias("place", "event")).select("connection", "generation", "seq", "t_ns", "kind", "place", "event.*")
    return events, held.filter("bad").select("malformed")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot or report file: one row per shard with the run's fields."""
    return spark.read.schema(REPORT).json(path, multiLine=True).select("schema", "reason", "qualified", "window_seconds", F.explode("shards").alias("s")).select("schema", "reason", "qualified", "window_seconds", "s.*")


def read_markets(spark: SparkSession, path: str) -> DataFrame:
    """Captured discovery answers: one row per market of an event, for the selection operators."""
    schema = "id string, tag string, startDate string, markets array<struct<conditionId:string,clobTokenIds:array<string>,endDate:string>>"
    rows = spark.read.schema(schema).json(path).select(F.col("id").alias("event"), "tag", F.unix_timestamp(F.to_timestamp("startDate")).alias("start"), F.explode("markets").alias("m"))
    return rows.select("event", "tag", "start", F.col("m.conditionId").alias("market"), F.col("m.clobTokenIds").alias("tokens"), F.unix_timestamp(F.to_timestamp("m.endDate")).alias("end_epoch"))


def attach(spark: SparkSession, segment: str, market: str) -> DataFrame:
    """The published states of one market; an error if the segment has none."""
    rows = spark.read.parquet(segment).filter(F.col("market") == market)
    if rows.isEmpty():
        raise NotInstalled("market not installed in the segment")
    return rows
