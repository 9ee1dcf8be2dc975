"""Fusion of channel batches into one ranked list a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.eligibility import small

RRF_K = 60


def union_channels(**batches: DataFrame) -> DataFrame:
    """request_id, channel, channel_rank, memory_id, updated_at, limit of all batches."""
    parts = [b.select("request_id", F.lit(name).alias("channel"), "channel_rank", "memory_id", "updated_at", "limit") for name, b in batches.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reciprocal(k: int = RRF_K) -> Column:
    return F.lit(1.0) / (F.lit(k) + F.col("channel_rank"))


def fuse(hits: DataFrame, mode: str = "rrf", tier: bool = True, k: int = RRF_K) -> DataFrame:
    """request_id, memory_id, exact_tier, score, channels, final_rank.

    Structured hits add nothing and bring in no candidate. Scores are sums of reciprocal ranks only where
    more than one query channel of the request has hits; else, and in mode "best", the best reciprocal.
    """
    query = F.col("channel") != "structured"
    per = hits.groupBy("request_id", "memory_id", "updated_at", "limit").agg(
        F.max((F.col("channel") == "exact").cast("int")).alias("exact"), F.sum(F.when(query, reciprocal(k)).otherwise(0.0)).alias("total"),
        F.max(F.when(query, reciprocal(k))).alias("best"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))
    active = hits.where(query).groupBy("request_id").agg(F.countDistinct("channel").alias("active"))
    kept = per.where("best IS NOT NULL").join(active, "request_id")
    score = F.col("best") if mode == "best" else F.when(F.col("active") > 1, F.col("total")).otherwise(F.col("best"))
    scored = kept.select("request_id", "memory_id", "updated_at", "limit", (F.col("exact") if tier else F.lit(0)).alias("exact_tier"), F.round(score, 8).alias("score"), "channels")
    w = Window.partitionBy("request_id").orderBy(F.desc("exact_tier"), F.desc("score"), F.desc("updated_at"), F.desc("memory_id"))
    return scored.withColumn("final_rank", F.row_number().over(w))


def fuse_legacy(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Every list counts, structured too; no tier."""
    scored = hits.groupBy("request_id", "memory_id", "updated_at").agg(F.round(F.sum(reciprocal(k)), 8).alias("score"))
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), F.desc("updated_at"), F.desc("memory_id"))
    return scored.withColumn("final_rank", F.row_number().over(w))


def page_after(ranked: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """The page of ``size`` rows after the first, by keyset: rows whose descending keys lie below the last of page one."""
    w = Window.partitionBy("request_id").orderBy(*[F.desc(k) for k in keys])
    numbered = ranked.withColumn("__rn", F.row_number().over(w))
    cursor = numbered.where(F.col("__rn") == size).select("request_id", F.struct(*keys).alias("__cursor"))
    below = ranked.join(cursor, "request_id").where(F.struct(*keys) < F.col("__cursor"))
    return below.withColumn("page_rank", F.row_number().over(w)).where(F.col("page_rank") <= size).drop("__cursor")


def batch_violations(hits: DataFrame) -> DataFrame:
    """Batches whose ranks are not 1..n without gap or repeat."""
    return hits.groupBy("request_id", "channel").agg(F.count("*").alias("n"), F.max("channel_rank").alias("top"), F.countDistinct("channel_rank").alias("ranks"), F.countDistinct("memory_id").alias("ids")).where("n <> top OR n <> ranks OR n <> ids")


def encode_cursor(kind: str, timestamp: Column, row_id: Column, fingerprint: Column) -> Column:
    """Where the next page begins, bound to the filter it belongs to: URL-safe base64 of a JSON object."""
    value = F.to_json(F.struct(F.lit(kind).alias("kind"), timestamp.alias("timestamp"), row_id.alias("id"), F.lit(2).alias("version"), fingerprint.alias("fingerprint")))
    # base64 breaks its lines, which a cursor must not have.
    return F.rtrim(F.translate(F.base64(value.cast("binary")), "+/\r\n", "-_"), F.lit("="))


CURSOR_FIELDS = "kind string, timestamp string, id string, version int, fingerprint string"


def cursor_bytes(cursor: Column) -> Column:
    """What a cursor encodes; null where it is not shaped as one."""
    # URL-safe base64 keeps its length when it is padded; a rest of one sign is none.
    shaped = F.when((F.length(cursor) <= 4096) & cursor.rlike("^[A-Za-z0-9_-]+$"), F.concat(F.translate(cursor, "-_", "+/"), F.substring(F.lit("==="), F.lit(1), F.pmod(-F.length(cursor), F.lit(4)))))
    return F.try_to_binary(shaped, F.lit("base64"))


def with_cursor(rows: DataFrame, cursor: Column, kind: str, fingerprint: Column, names: tuple[str, str, str]) -> DataFrame:
    """``rows`` with timestamp, id and why a cursor can't be used, as ``decode_cursor``. Each step is a column of its own, worked out once a row."""
    text = rows.withColumn("__cursor", cursor).withColumn("__raw", cursor_bytes(F.col("__cursor")).cast("string"))
    v = F.col("__value")
    return text.withColumn("__value", F.from_json("__raw", CURSOR_FIELDS)).withColumns(dict(zip(names, _judged(v, kind, fingerprint), strict=True))).drop("__cursor", "__raw", "__value")


def _judged(v: Column, kind: str, fingerprint: Column) -> tuple[Column, Column, Column]:
    whole = F.coalesce((v["kind"] == kind) & (F.length(v["id"]) > 0) & F.try_to_timestamp(v["timestamp"]).isNotNull(), F.lit(False))
    why = F.when(~whole, "invalid_cursor").when(v["version"].isNull(), "legacy_cursor_restart_required").when((v["version"] != 2) | ~v["fingerprint"].eqNullSafe(fingerprint), "cursor_filter_mismatch")
    return v["timestamp"], v["id"], why


def decode_cursor(cursor: Column, kind: str, fingerprint: Column) -> tuple[Column, Column, Column]:
    """timestamp, id and why a cursor can't be used (null: it can): not one of this kind, made before cursors had filters, or of another filter.
    For few rows; ``with_cursor`` is for many."""
    return _judged(F.from_json(cursor_bytes(cursor).cast("string"), CURSOR_FIELDS), kind, fingerprint)


RANKED = ["exact_tier", "score", "updated_at", "memory_id"]


def encode_ranked_cursor(fingerprint: Column) -> Column:
    """Where the next page of a ranked list begins: its last row's keys, bound to the request and the policy that ranked it."""
    value = F.to_json(F.struct(F.lit("retrieval").alias("kind"), "score", F.col("updated_at").cast("string").alias("timestamp"), F.col("memory_id").alias("id"), fingerprint.alias("fingerprint"), F.lit(2).alias("version"), F.col("exact_tier").alias("exactTier")))
    return F.rtrim(F.translate(F.base64(value.cast("binary")), "+/\r\n", "-_"), F.lit("="))


def decode_ranked_cursor(cursor: Column, fingerprint: Column, timestamp_type: str = "bigint") -> tuple[Column, Column]:
    """The keys of RANKED as a struct, and whether the cursor can be used: shaped as one of this kind and version, made for this fingerprint."""
    shaped = F.when((F.length(cursor) <= 4096) & cursor.rlike("^[A-Za-z0-9_-]+$"), F.translate(cursor, "-_", "+/"))
    raw = F.try_to_binary(F.rpad(shaped, (F.ceil(F.length(shaped) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))
    v = F.from_json(raw.cast("string"), "kind string, score double, timestamp string, id string, fingerprint string, version int, exactTier int")
    good = (v["kind"] == "retrieval") & v["score"].isNotNull() & ~F.isnan(v["score"]) & (F.length(v["id"]) > 0) & v["timestamp"].isNotNull() & (v["version"] == 2) & v["exactTier"].isin(0, 1) & (v["fingerprint"] == fingerprint)
    return F.struct(v["exactTier"].alias("exact_tier"), v["score"].alias("score"), v["timestamp"].try_cast(timestamp_type).alias("updated_at"), v["id"].alias("memory_id")), F.coalesce(good, F.lit(False))


def ranked_page(ranked: DataFrame, pages: DataFrame) -> DataFrame:
    """One page of each request's list: the rows below its cursor, ``limit`` of them, with page_rank and next_cursor (null: no further row).

    ``ranked``: request_id and RANKED. ``pages``: request_id, limit, cursor (null: from the first row), fingerprint; a cursor that
    can't be used raises. The lower bound is joined in before any row is numbered, so a page costs its own rows, not those before it.
    """
    keys, good = decode_ranked_cursor(F.col("cursor"), F.col("fingerprint"), ranked.schema["updated_at"].dataType.simpleString())
    checked = F.when(F.col("cursor").isNull() | good, keys).otherwise(F.raise_error(F.lit("Invalid retrieval pagination cursor")).cast(keys_type(ranked)))
    bounds = pages.select("request_id", F.col("limit").alias("__limit"), F.col("cursor").isNull().alias("__first"), checked.alias("__from"), F.col("fingerprint").alias("__fingerprint"))
    below = ranked.join(bounds, "request_id").where(F.col("__first") | (F.struct(*RANKED) < F.col("__from")))
    w = Window.partitionBy("request_id").orderBy(*[F.desc(k) for k in RANKED])
    numbered = below.withColumn("page_rank", F.row_number().over(w)).where(F.col("page_rank") <= F.col("__limit") + 1)
    more = F.max("page_rank").over(Window.partitionBy("request_id")) > F.col("__limit")
    cut = numbered.withColumn("__more", more).where(F.col("page_rank") <= F.col("__limit"))
    last = F.col("__more") & (F.col("page_rank") == F.col("__limit"))
    marked = cut.withColumn("__cursor", F.when(last, encode_ranked_cursor(F.col("__fingerprint"))))
    return marked.withColumn("next_cursor", F.max("__cursor").over(Window.partitionBy("request_id"))).drop("__limit", "__first", "__from", "__fingerprint", "__more", "__cursor")


def keys_type(ranked: DataFrame) -> str:
    return f"struct<exact_tier:int,score:double,updated_at:{ranked.schema['updated_at'].dataType.simpleString()},memory_id:string>"


def record_page(rows: DataFrame, pages: DataFrame, kind: str, moment: str, row_id: str) -> DataFrame:
    """One page, newest first, of ``rows`` (request_id, ``moment`` in epoch microseconds, ``row_id``) for each of ``pages`` (request_id, limit, cursor,
    fingerprint), with page_rank and next_cursor. As ``ranked_page``: the bound of a decoded cursor is joined in before rows are numbered."""
    kind_of = rows.schema[row_id].dataType.simpleString()
    at, last_id, why = decode_cursor(F.col("cursor"), kind, F.col("fingerprint"))
    bad = F.when(F.col("cursor").isNotNull() & why.isNotNull(), F.raise_error(why).cast("bigint")).otherwise(F.unix_micros(F.try_to_timestamp(at)))
    bounds = pages.select("request_id", F.col("limit").alias("__limit"), F.col("fingerprint").alias("__fingerprint"), F.col("cursor").isNull().alias("__first"), bad.alias("__at"), last_id.try_cast(kind_of).alias("__id"))
    # As a literal, the largest limit lets Spark drop rows in each task before the shuffle (a group limit).
    most = pages.agg(F.coalesce(F.max("limit"), F.lit(0))).first()[0]
    below = rows.join(small(bounds), "request_id").where(F.col("__first") | (F.struct(F.col(moment), F.col(row_id)) < F.struct(F.col("__at").alias(moment), F.col("__id").alias(row_id))))
    w = Window.partitionBy("request_id").orderBy(F.desc(moment), F.desc(row_id))
    numbered = below.withColumn("page_rank", F.row_number().over(w)).where(F.col("page_rank") <= most + 1).where(F.col("page_rank") <= F.col("__limit") + 1)
    cut = numbered.withColumn("__more", F.max("page_rank").over(Window.partitionBy("request_id")) > F.col("__limit")).where(F.col("page_rank") <= F.col("__limit"))
    cursor = encode_cursor(kind, F.timestamp_micros(moment).cast("string"), F.col(row_id).cast("string"), F.col("__fingerprint"))
    marked = cut.withColumn("__cursor", F.when(F.col("__more") & (F.col("page_rank") == F.col("__limit")), cursor))
    return marked.withColumn("next_cursor", F.max("__cursor").over(Window.partitionBy("request_id"))).drop("__limit", "__fingerprint", "__first", "__at", "__id", "__more", "__cursor")
