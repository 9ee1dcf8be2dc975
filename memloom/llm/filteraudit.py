"""How filters interact: what each removes at every place in every order, executed over a trie of permutations.

A node of the trie is a prefix of an order. What survives a prefix depends on which filters it holds, not on their
order, so all prefixes of the same filters share one state: a persisted DataFrame of survivors, made from its parent's by one more
filter. States are visited depth first, an edge (state, next filter) is counted on the survivors when its state is first
visited, and a state is let go of once all below it are done: no more of them are held at once than there are filters. Five filters have 325
edges in the trie, 32 states and 80 edges between states.

Survivors are slim rows: the document's part, its labels and whether it fails each filter, which is decided once from its text.
"""

from __future__ import annotations

import itertools
import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.textio import join_sums, shared_path, stored, table

WORD_BREAK = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_UPPER_PERCENT = 200, 50, 2
ODD = r"[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
EDGE = "part string, state int, filter string, reached bigint, removed bigint, good_lost bigint, toxic_lost bigint"


def failures(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails filters A to D."""
    split = F.filter(F.split(text, WORD_BREAK, -1), lambda w: w != "")
    # The words are an argument of the function, so that a text is split once.
    counted = F.transform(F.array(split), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {"words": counted, "C": 100 * upper.cast("bigint") > MOST_UPPER_PERCENT * F.length(text).cast("bigint"), "D": text.rlike(ODD)}


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (whether the document fails), good and toxic (0 or 1) of each row of ``docs``.

    E compares texts by their sha256. Of labels given twice for a doc_id, 1 counts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    flags = failures(F.col("text"))
    read = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("text"))
    seen = read.select("doc_id", "part", flags["words"].alias("w"), flags["C"].alias("C"), flags["D"].alias("D"), F.unhex(F.sha2("text", 256)).alias("digest"))
    kept = stored(seen.select("doc_id", "part", (F.col("w.n") < LEAST_WORDS).alias("A"), (100 * F.col("w.distinct").cast("bigint") < LEAST_DISTINCT_PERCENT * F.col("w.n").cast("bigint")).alias("B"), "C", "D", "digest"), "judged")
    least = kept.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = join_sums(kept, least, ["digest"], "left").withColumn("E", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("int")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    one = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return found.drop("first", "digest").join(marks, "doc_id", "left").select("part", "A", "B", "C", "D", "E", one("good"), one("toxic"))


def edges(rows: DataFrame, filters: list[str]) -> DataFrame:
    """part, state (bits of the filters already applied), filter, reached (survivors of the state), removed, good_lost, toxic_lost.

    ``rows``: part, a boolean for each of ``filters`` (true: fails), good, toxic. A part of which nothing reaches a
    state has no row there.
    """
    spark = rows.sparkSession
    path = shared_path(spark, "edges")
    known: set[int] = set()
    sums = F.array(*[F.struct(F.lit(f).alias("filter"), F.count_if(F.col(f)).alias("removed"), F.count_if(F.col(f) & (F.col("good") == 1)).alias("good_lost"), F.count_if(F.col(f) & (F.col("toxic") == 1)).alias("toxic_lost")) for f in filters])

    def visit(state: int, survivors: DataFrame) -> None:
        known.add(state)
        left = [(i, f) for i, f in enumerate(filters) if not state >> i & 1]
        if not left:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        # All edges that leave the state, in one pass over its survivors. Filters already applied are counted too (and remove
        # nothing), so that all states share their compiled code.
        survivors.groupBy("part").agg(F.count("*").alias("reached"), sums.alias("e")).select("part", "reached", F.inline("e")).coalesce(1).write.parquet(f"{path}/state={state}")
        for i, f in left:
            if state | 1 << i not in known:
                visit(state | 1 << i, survivors.where(~F.col(f)))
        survivors.unpersist()

    visit(0, rows)
    bit = F.element_at(F.create_map(*[x for i, f in enumerate(filters) for x in (F.lit(f), F.lit(1 << i))]), F.col("filter"))
    return spark.read.schema(EDGE).parquet(path).where(F.col("state").bitwiseAND(bit) == 0)


def audit(docs: DataFrame, labels: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """For each part (source; null: empty), each order of ``filters`` and each step: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley, all zeros included.

    ``docs``: doc_id, text, source; ``labels``: doc_id, quality, toxic. A null text is empty: it fails A alone, and E if a smaller doc_id
    has an empty text too. A row of null doc_id has no label, is never a duplicate and makes none; rows that share doc_id and text are
    not duplicates of each other. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    names = list(filters)
    found = edges(judged(docs, labels), names)
    orders = [("".join(o), k + 1, f, sum(1 << names.index(x) for x in o[:k])) for o in itertools.permutations(names) for k, f in enumerate(o)]
    steps = spark.createDataFrame(orders, "filter_order string, step int, filter string, state int")
    all_ = 2 ** len(names) - 1
    root = found.where("state = 0").select("part", "filter", F.col("removed").alias("failing"))
    last = F.lit(all_) - F.element_at(F.create_map(*[x for i, f in enumerate(names) for x in (F.lit(f), F.lit(1 << i))]), F.col("filter"))
    only = found.where(F.col("state") == last).select("part", "filter", F.col("removed").alias("unique_fails"))
    weighed = found.select("part", "filter", "removed", F.bit_count("state").alias("before"))
    share = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(len(names) - 1 - k)) for k in range(len(names))]), F.col("before") + 1)
    shapley = weighed.groupBy("part", "filter").agg(F.sum(F.col("removed") * share).alias("shapley"))
    each = root.join(only, ["part", "filter"], "left").join(shapley, ["part", "filter"])
    rows = each.join(F.broadcast(steps), "filter").join(found.select("part", "state", "filter", "reached", "removed", "good_lost", "toxic_lost"), ["part", "state", "filter"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return rows.select("part", "filter_order", "step", (n("reached") - n("removed")).alias("kept"), n("removed").alias("removed"), (n("failing") - n("removed")).alias("redundant"),
                       n("unique_fails").alias("unique_fails"), n("good_lost").alias("good_lost"), n("toxic_lost").alias("toxic_lost"), n("shapley").alias("shapley"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


_FAILS = "CASE f WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END"

OP11_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
judged AS (
  SELECT doc_id, part, len(words) < {LEAST_WORDS} AS a, 100 * len(list_distinct(words)) < {LEAST_DISTINCT_PERCENT} * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_UPPER_PERCENT} * length(text) AS c, regexp_matches(text, '{ODD}') AS d,
         coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e FROM docs),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
kinds AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM judged LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
steps AS (SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS f, substr(filter_order, 1, k - 1) AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS k)),
met AS (SELECT part, filter_order, step, f, n, good, toxic, {_FAILS} AS fails,
  (a AND contains(earlier, 'A')) OR (b AND contains(earlier, 'B')) OR (c AND contains(earlier, 'C')) OR (d AND contains(earlier, 'D')) OR (e AND contains(earlier, 'E')) AS gone,
  a::INT + b::INT + c::INT + d::INT + e::INT AS failed FROM steps, kinds),
counted AS (SELECT part, filter_order, step, f,
  coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (fails AND failed = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted
"""
