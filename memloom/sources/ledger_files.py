"""Ledger interchange: versioned JSON ledgers, and packages of JSON lines with a manifest that import verifies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.ledger import current

EVENT_SCHEMA = "event_id bigint, event_seq bigint, user_id bigint, memory_key bigint, is_forget boolean, kind string, value double, idempotency_key string"


class PackageError(ValueError):
    """A package whose lines do not match its manifest, or whose memories do not follow from its events."""


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON ledgers: {"events": [...]} or {"schemaVersion": 2, "eventsV2": [...]}; other versions are refused."""
    schema = f"schemaVersion int, events array<struct<{_fields()}>>, eventsV2 array<struct<{_fields()}>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    known = F.col("schemaVersion").isNull() | (F.col("schemaVersion") == 2)
    checked = raw.where(F.when(known, True).otherwise(F.raise_error(F.lit("unknown ledger version"))))
    events = F.when(F.col("schemaVersion") == 2, F.col("eventsV2")).otherwise(F.col("events"))
    return checked.select(F.explode(events).alias("e")).select("e.*")


def _fields() -> str:
    return ", ".join(f"{n}:{t}" for n, t in (x.split() for x in EVENT_SCHEMA.split(", ")))


def lines(rows: DataFrame, order: list[str]) -> DataFrame:
    return rows.orderBy(*order).select(F.to_json(F.struct(*rows.columns)).alias("value"))


def checksum(rows: DataFrame) -> tuple[int, str]:
    """Row count and a digest that does not depend on the order of the rows, summed in parallel."""
    each = F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return n, f"{int(total):x}"


def export_package(events: DataFrame, path: str) -> None:
    """events, memories and manifest under ``path``."""
    spark = events.sparkSession
    parts = {"events": lines(events.select(*[c.split()[0] for c in EVENT_SCHEMA.split(", ")]), ["event_seq", "event_id"]),
             "memories": lines(current(events).select("user_id", "memory_key", "memory_id", "event_id", "version", "kind", "value"), ["user_id", "memory_key"])}
    manifest = []
    for name, rows in parts.items():
        rows.write.mode("errorifexists").text(f"{path}/{name}")
        manifest.append((name, *checksum(spark.read.text(f"{path}/{name}"))))
    spark.createDataFrame(manifest, "name string, rows bigint, digest string").coalesce(1).write.json(f"{path}/manifest")


def import_package(spark: SparkSession, path: str, user_id: int | None = None) -> DataFrame:
    """The events of a package, after its checksums hold and its memories follow from its events; ``user_id`` rebinds them."""
    for name, rows, digest in spark.read.schema("name string, rows bigint, digest string").json(f"{path}/manifest").collect():
        if checksum(spark.read.text(f"{path}/{name}")) != (rows, digest):
            raise PackageError(f"{name} does not match its manifest")
    events = spark.read.schema(EVENT_SCHEMA).json(f"{path}/events")
    replayed = current(events).select("user_id", "memory_key", "memory_id", "event_id", "version", "kind", "value")
    stated = spark.read.schema(replayed.schema).json(f"{path}/memories")
    if replayed.exceptAll(stated).limit(1).count() or stated.exceptAll(replayed).limit(1).count():
        raise PackageError("memories do not follow from events")
    return events if user_id is None else events.withColumn("user_id", F.lit(user_id).cast("bigint"))
