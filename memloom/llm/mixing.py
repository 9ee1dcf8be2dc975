"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated k times, k from a Poisson distribution whose mean is
the target rate of s: (target share of s) x (rows wanted) / (rows of s). The uniform number
that is inverted comes from a hash of the document and a seed, so every run and
every retry repeats each document equally often. Copies are then shuffled globally.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.textio import table

SEED = 17
#: Sources that are broadcast; more are joined by a shuffle with salted rows.
MOST_BROADCAST = 20_000
SALTS = 32
#: A count of a rate above this is the sum of several independent ones, each of a rate within it, which keeps e^-rate above 0.
MOST_RATE = 32.0


def uniform(what: Column, seed: int) -> Column:
    """In [0, 1), from the first 52 bits of md5(seed:what)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(what.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The least k with u < P(X <= k), for rates up to MOST_RATE: terms are summed until they pass ``u``."""
    most = int(MOST_RATE + 12 * math.sqrt(MOST_RATE) + 12)
    first = F.exp(-rate)
    start = F.struct(first.alias("term"), first.alias("sum"), F.when(u < first, 0).otherwise(1).alias("k"))
    step = lambda a, i: F.struct(
        (a["term"] * rate / i).alias("term"), (a["sum"] + a["term"] * rate / i).alias("sum"),
        F.when(u < a["sum"] + a["term"] * rate / i, a["k"]).otherwise(a["k"] + 1).alias("k"))
    # Where the first terms already pass u, no later one is looked at.
    low = F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step)
    later = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["k"]
    return F.when(u < first, 0).otherwise(F.when(u < low["sum"], low["k"]).otherwise(later))


def poisson_count(what: Column, rate: Column, seed: int) -> Column:
    """A Poisson count of any ``rate``: a sum of Poisson counts is one of the summed rate."""
    draws = F.greatest(F.ceil(rate / F.lit(MOST_RATE)), F.lit(1)).cast("int")
    part = rate / draws
    name = F.coalesce(what.cast("string"), F.lit("null"))
    # The first draw is that of the document alone.
    drawn = F.transform(F.sequence(F.lit(1), draws), lambda j: uniform(F.when(j == 1, name).otherwise(F.concat(name, F.lit(":draw:"), j.cast("string"))), seed))
    return F.aggregate(drawn, F.lit(0), lambda total, u: total + poisson_inverse(u, part))


def row_name(docs: DataFrame) -> Column:
    """What a row's draws and places depend on: its doc_id, and without one its text."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))) if "text" in docs.columns else F.lit("")
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), text))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, rows: int | None = None, power: float = 0.5) -> DataFrame:
    """source, n, rate. Without ``weights`` a source's share is its row count to ``power``.

    ``rows``: rows wanted, all by default. Sources without a weight have rate 0. A null
    source is a source of its own (named null in ``weights`` by the key "").
    """
    spark = docs.sparkSession
    counts = docs.groupBy(F.col("source").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        share = F.sqrt("n") if power == 0.5 else F.pow(F.col("n").cast("double"), F.lit(power))
        shares = counts.withColumn("share", share)
    else:
        given = spark.createDataFrame([(k or None, float(v)) for k, v in weights.items()], "name string, share double")
        shares = counts.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("name")), "left").select("source", "n", F.coalesce("share", F.lit(0.0)).alias("share"))
    total = shares.agg(F.sum("share").alias("all_shares"), F.sum("n").alias("all_rows"))
    wanted = F.col("all_rows") if rows is None else F.lit(rows)
    rate = F.round(wanted * F.col("share") / F.col("all_shares") / F.col("n"), 9)
    return shares.join(F.broadcast(total)).select("source", "n", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, rows: int | None = None, power: float = 0.5, seed: int = SEED) -> DataFrame:
    """``docs``' columns once for each copy, globally shuffled, and __copy (from 1), __copies, __rate, __place.

    Rows are told apart by doc_id, those without one by their text: rows that share it are repeated equally
    often and lie side by side. __place (in [0, 1)) is the row's place in the global order. Empty in, empty out.
    """
    spark = docs.sparkSession
    names = [f"__c{i}" for i in range(len(docs.columns))]
    doc_id = names[docs.columns.index("doc_id")]
    plan = rates(docs, weights, rows, power).where("rate > 0")
    rows_ = docs.select("*", row_name(docs)).toDF(*names, "__name")
    source = F.col(names[docs.columns.index("source")])
    counted = plan.limit(MOST_BROADCAST + 1).count()
    named = plan.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    if counted <= MOST_BROADCAST:
        rated = rows_.join(F.broadcast(named), source.eqNullSafe(F.col("__source")))
    else:  # a hot source is dealt over SALTS keys
        salted = named.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int")
        rated = rows_.withColumn("__salted", salt).join(salted, source.eqNullSafe(F.col("__source")) & (F.col("__salted") == F.col("__salt")))
    repeated = rated.withColumn("__copies", poisson_count(F.col("__name"), F.col("__rate"), seed)).where("__copies > 0")
    copies = repeated.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    place = uniform(F.concat_ws(":", "__name", "__copy"), seed + 1)
    placed = copies.withColumn("__place", F.round(place, 12))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Places are uniform, so equal intervals are equal parts: no sampling pass as a range partitioning needs.
    shuffled = placed.repartitionById(parts, F.least(F.floor(F.col("__place") * parts), F.lit(parts - 1)).cast("int")).sortWithinPartitions("__place", doc_id)
    return shuffled.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)], "__copy", "__copies", "__rate", "__place")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    mixed = mix(docs)
    return mixed.select(
        "doc_id", "source", F.col("__copy").cast("bigint").alias("copy"), F.col("__copies").cast("bigint").alias("copies"),
        F.round("__rate", 6).alias("rate"), F.round("__place", 9).alias("place"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


OP1_SQL = f"""
WITH counts AS (SELECT source, count(*) AS n, sqrt(count(*)) AS share FROM documents GROUP BY source),
rates AS (SELECT source, n, round((SELECT sum(n) FROM counts) * share / (SELECT sum(share) FROM counts) / n, 9) AS rate FROM counts),
docs AS (
  SELECT d.doc_id, d.source, d.text, r.rate,
         ('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null' || md5(coalesce(d.text, '')))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
terms AS (
  SELECT source, rate, t.k, exp(-rate) * pow(rate, t.k) / factorial(CAST(t.k AS INTEGER)) AS p
  FROM rates, (SELECT unnest(range(0, 33)) AS k) t),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
counted AS (
  SELECT d.doc_id, d.source, d.text, d.rate, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u) AS copies
  FROM docs d),
copied AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted WHERE copies > 0)
SELECT doc_id, source, CAST(copy AS BIGINT) AS copy, CAST(copies AS BIGINT) AS copies, round(rate, 6) AS rate,
       round(round(('0x' || substr(md5('{SEED + 1}:' || coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(coalesce(text, ''))) || ':' || copy), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0, 12), 9) AS place,
       md5(coalesce(text, '')) AS text_md5
FROM copied
"""
