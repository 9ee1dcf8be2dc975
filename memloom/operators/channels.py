"""Lookup channels over a batch of requests, and what text channels share: terms, trigrams, edits, bounded ranked output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.eligibility import eligible, small

MOST_LIMIT = 100
#: Distinct terms, and their characters, that go to every task.
MOST_TERMS, MOST_TERM_CHARS = 50_000, 4 << 20
# Characters of a scored term, and the bounds of the spelling fallback.
LEAST_TERM = 3
MOST_FALLBACK_TERMS, LEAST_WORD, MOST_WORD, MOST_TEXT_BYTES, MOST_TEXT_WORDS = 8, 5, 32, 65_536, 256
BM25_K1, BM25_B, LEAST_IDF = 1.2, 0.75, 1e-6


def recency() -> list[Column]:
    return [F.desc("updated_at"), F.desc("memory_id")]


def top_k(candidates: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """The best ``limit`` a request with channel_rank and truncated; the row after the last only sets the flag.
    A limit over MOST_LIMIT, which validation refuses, raises."""
    w = Window.partitionBy("request_id").orderBy(*(order or recency()))
    limit = F.when(F.col("limit") > MOST_LIMIT, F.raise_error(F.lit(f"a limit is over {MOST_LIMIT}")).cast("int")).otherwise(F.col("limit"))
    # The literal bound lets Spark drop rows below it in each task before the shuffle (a group limit).
    ranked = candidates.withColumn("channel_rank", F.row_number().over(w)).where(F.col("channel_rank") <= MOST_LIMIT + 1).withColumn("limit", limit).where(F.col("channel_rank") <= F.col("limit") + 1)
    more = F.max("channel_rank").over(Window.partitionBy("request_id")) > F.col("limit")
    return ranked.withColumn("truncated", more).where(F.col("channel_rank") <= F.col("limit"))


def _fields(pairs: DataFrame, *more: Column) -> DataFrame:
    return pairs.select("r.request_id", "r.limit", "m.memory_id", "m.updated_at", *more)


def exact(requests: DataFrame, memories: DataFrame) -> DataFrame:
    return top_k(_fields(eligible(requests, memories, F.col("m.memory_key") == F.col("r.key"))))


def structured(requests: DataFrame, memories: DataFrame) -> DataFrame:
    return top_k(_fields(eligible(requests, memories, F.col("m.kind") == F.col("r.kind"))))


def contains_folded(text: Column, term: Column) -> Column:
    """Case-folded literal substring: % and _ mean themselves."""
    return F.contains(F.lower(text), F.lower(term))


def all_terms(terms: Column, *texts: Column) -> Column:
    """Every term occurs in one of ``texts``, each wherever it likes; with no terms nothing matches."""
    held = lambda t: reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(x), F.lower(t)), F.lit(False)) for x in texts])
    return (F.size(terms) > 0) & F.forall(terms, held)


def substring(requests: DataFrame, memories: DataFrame) -> DataFrame:
    """The whole query as a substring of key or value, by recency."""
    q = F.col("r.query")
    return top_k(_fields(eligible(requests, memories, contains_folded(F.col("m.memory_key"), q) | contains_folded(F.col("m.value"), q))))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams; none for fewer than three characters."""
    # A lookahead matches at every place, so the text is walked once.
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))


def postings(memories: DataFrame) -> DataFrame:
    """The inverted trigram table: trigram, memory_id. Written once, it serves any number of queries."""
    text = F.concat_ws("\n", F.lower("memory_key"), F.lower("value"))
    return memories.select("memory_id", F.explode(trigrams(text)).alias("trigram"))


def by_postings(requests: DataFrame, table: DataFrame) -> DataFrame:
    """request_id, memory_id of memories that hold all trigrams of the query: what a large batch of
    requests verifies, in place of every memory."""
    wanted = requests.select("request_id", F.explode(trigrams(F.lower("query"))).alias("trigram")).distinct()
    need = wanted.groupBy("request_id").agg(F.count("*").alias("need"))
    met = small(wanted).join(table, "trigram").groupBy("request_id", "memory_id").agg(F.count("*").alias("met"))
    return met.join(need, "request_id").where("met = need").select("request_id", "memory_id")


def query_terms(query: Column) -> Column:
    """Distinct lower-case terms of a query, by white space."""
    return F.filter(F.array_distinct(F.split(F.lower(F.trim(query)), r"\s+")), lambda t: t != "")


def one_edit(query: Column, word: Column) -> Column:
    """insert, delete, substitute or adjacent transpose; null for equality and for more edits."""
    n, m = F.length(query), F.length(word)
    at = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(query, i, F.lit(1)) != F.substring(word, i, F.lit(1)))
    swapped = (F.size(at) == 2) & (at[1] == at[0] + 1) & (F.substring(query, at[0], F.lit(1)) == F.substring(word, at[1], F.lit(1))) & (F.substring(query, at[1], F.lit(1)) == F.substring(word, at[0], F.lit(1)))
    near = F.levenshtein(query, word)
    return (F.when((query == word) | ~word.rlike("^[a-z]+$") | (F.abs(n - m) > 1), F.lit(None))
            .when((n == m) & (near == 1), "substitute").when((n == m) & swapped, "transpose").when((n == m + 1) & (near == 1), "delete").when((m == n + 1) & (near == 1), "insert"))


def fallback_terms(query: Column) -> Column:
    """Terms of a query that may be misspelt; null where it is not 1 to 8 Latin words of up to 32 letters, one of 5 or more."""
    terms = query_terms(query)
    fits = F.trim(query).rlike(r"^[a-zA-Z]+(?:\s+[a-zA-Z]+)*$") & (F.size(terms) <= MOST_FALLBACK_TERMS) & F.forall(terms, lambda t: F.length(t) <= MOST_WORD) & F.exists(terms, lambda t: F.length(t) >= LEAST_WORD)
    return F.when(fits, terms)
