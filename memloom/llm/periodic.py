"""Runs of periodic words: found by naming stretches of power-of-two lengths (Karp, Miller, Rosenberg).

A run is a stretch of words with smallest period q, at least ``max(LEAST_WORDS, 2 q)`` long, that no
neighbouring word extends. Level k names each stretch of 2^k words so that two stretches of a text
share a name where they are equal; level k + 1 names pairs of names of level k. How far two places of a text agree
is then read off by descending levels. A run of period q holds two grid places i and i + q, i a multiple of q, that agree to
both sides over enough words, so these pairs are the only candidates: n / q for a period, n log n for a text.

A stretch that occurs once in its text agrees with nothing. It gets no name, and no level is built on it: plain prose is
done after two or three levels, and only periods that the highest level can hold are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.textio import in_batches, pieces, ragged, table, words

LEAST_WORDS = 12
#: Text bytes whose names are held at once (a longer text is held alone), and candidates looked at in one step.
NAMED_BYTES, STEP = 2 << 20, 1 << 19
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Names:
    """Names of all stretches of 2^k words that occur more than once in their text; -1 for all others."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray):
        self.size = len(codes)
        sizes = np.diff(offsets)
        text = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        self.stop = np.repeat(offsets[1:], sizes)
        self.levels: list[np.ndarray] = []
        at = np.arange(self.size, dtype=np.int64)
        keys = text * (int(codes.max(initial=0)) + 1) + codes
        while True:
            level, at = self._named(at, keys)
            if not len(at):
                break
            self.levels.append(level)
            width = 1 << (len(self.levels) - 1)
            at = at[at + 2 * width <= self.stop[at]]
            at = at[level[at + width] >= 0]
            keys = level[at].astype(np.int64) * self.size + level[at + width]
        #: The highest level at which a text has a name, and all levels as one table with an empty last column.
        self.top = np.full(len(sizes), -1)
        for k, level in enumerate(self.levels):
            self.top[text[level[:-1] >= 0]] = k
        self.table = np.stack(self.levels) if self.levels else np.full((1, self.size + 1), -1, np.int32)

    def _named(self, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal keys get one name where there are several: the level, and its places that have a name."""
        level = np.full(self.size + 1, -1, np.int32)
        if not len(at):
            return level, at
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        rank = np.cumsum(new) - 1
        again = (np.bincount(rank) > 1)[rank]
        level[at[order[again]]] = rank[again]
        return level, at[np.sort(order[again])]

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j on (j > i, both in one text)."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            a = self.levels[k][i]
            step = ((a >= 0) & (a == self.levels[k][j])).astype(np.int64) << k
            i += step
            j += step
        return i - begin

    def before(self, k, i: np.ndarray) -> np.ndarray:
        """The name of the 2^k words that end before i."""
        at = i - (np.int64(1) << k)
        return self.table[k, np.where(at < 0, self.size, at)]

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree before i and before j."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            a = self.before(k, i)
            step = ((a >= 0) & (a == self.before(k, j))).astype(np.int64) << k
            i -= step
            j -= step
        return begin - i


def needed(period: np.ndarray) -> np.ndarray:
    """Words that must agree around a grid pair of a run of each period, at least."""
    return np.maximum(LEAST_WORDS - period, period)


def level_of(period: np.ndarray) -> np.ndarray:
    """The level of a stretch that must agree to the one side or the other: half of ``needed``, rounded down to a power of two."""
    half = (needed(period) + 1) // 2
    return np.frexp(half.astype(np.float64))[1] - 1


def find_runs(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start (place among all words), length and period of the runs of each text ``codes[offsets[i]:offsets[i + 1]]``,
    by start, then period."""
    names = Names(codes, offsets)
    sizes = np.diff(offsets)
    # Half of p, rounded up, is below 2^(top + 1).
    most = np.where(names.top >= 1, np.minimum(sizes // 2, (np.int64(4) << np.maximum(names.top, 0)) - 2), 0)
    found = [np.zeros((3, 0), dtype=np.int64)]
    text = np.repeat(np.arange(len(sizes)), most)
    period = ragged(np.ones(len(sizes), dtype=np.int64), most)
    fits = level_of(period) <= names.top[text] if len(period) else np.zeros(0, dtype=bool)
    text, period = text[fits], period[fits]
    counts = (sizes[text] - 1) // period
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, STEP):
        high = min(low + STEP, total)
        first, last = np.searchsorted(ends, low, side="right"), np.searchsorted(ends, high, side="left")
        own = np.arange(first, last + 1)
        begins = np.maximum(ends[own] - counts[own], low)
        pair = np.repeat(own, np.minimum(ends[own], high) - begins)
        nth = np.arange(low, high) - (ends[pair] - counts[pair])
        p = period[pair]
        i = offsets[text[pair]] + nth * p
        k = level_of(p)
        a, b = names.table[k, i], names.before(k, i)
        near = np.flatnonzero(((a >= 0) & (a == names.table[k, i + p])) | ((b >= 0) & (b == names.before(k, i + p))))
        if not len(near):
            continue
        i, p = i[near], p[near]
        back, on = names.backward(i, i + p), names.forward(i, i + p)
        # One grid place of a run has less than a period of it before.
        own_run = np.flatnonzero((back + on >= needed(p)) & (back < p))
        i, p, back, on = i[own_run], p[own_run], back[own_run], on[own_run]
        found.append(np.stack([i - back, back + on + p, p]))
    start, length, period = np.concatenate(found, axis=1)
    # A stretch that has several periods is a run of the smallest.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    keep = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])[: len(start)]
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def collapsed(codes: np.ndarray, offsets: np.ndarray, known: pa.Array, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> pa.Array:
    """Each text's words, one space apart, without those that a run holds after its first period."""
    edges = np.bincount(start + period, minlength=len(codes) + 1) - np.bincount(start + length, minlength=len(codes) + 1)
    kept = np.cumsum(edges)[: len(codes)] == 0
    ends = np.concatenate([[0], np.cumsum(kept)])[offsets]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), known.take(pa.array(codes[kept])))
    return pc.binary_join(lists, " ")


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        for piece in pieces(batch, "text", NAMED_BYTES):
            codes, offsets, known = words(piece.column("text"), lower=False)
            codes, offsets = codes.astype(np.int64), offsets.astype(np.int64)
            start, length, period = find_runs(codes, offsets)
            of_text = np.searchsorted(start, offsets)
            own = np.repeat(offsets[:-1], np.diff(of_text))
            runs = pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), pa.StructArray.from_arrays([pa.array(start - own), pa.array(length), pa.array(period)], ["start", "length", "period"]))
            texts = collapsed(codes, offsets, known, start, length, period)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), runs.cast(kind), texts.cast(pa.string())], ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (word start, length, period; by start, then period) and collapsed (the words that no run repeats, one space
    apart) of each row of ``docs`` (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+``, case kept. Null, empty and wordless texts have no run and collapse to the empty
    text; repeated rows are returned each, other columns of ``docs`` are not read; an empty table gives none. A text is
    worked on whole, in one task, with 4 bytes a word for each level that has names: log2 of its longest repeat.
    """
    return in_batches(docs.select("doc_id", "text"), _work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs {RUNS}, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, and for one document in ten (h % 10 = 0, h = crc32 of the decimal doc_id) its words from a on repeated with period p:
    a = g % n, p = 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10), n its words. A null doc_id keeps its text."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    held = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n = F.size(held)
    # The words are an argument of the fold, so that they are split once.
    rewritten = F.transform(F.array(F.struct(held.alias("w"), (g % n).cast("int").alias("a"))), lambda s: F.struct(
        s["w"].alias("w"), s["a"].alias("a"), (F.floor((F.size(s["w"]) - s["a"]) / (g % 8 + 3)) + 1).cast("int").alias("p")))
    joined = F.transform(rewritten, lambda s: F.array_join(F.transform(s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(
        F.get(s["w"], (s["a"] + F.pmod(i - s["a"], s["p"])).cast("int")))), " "))
    return F.when((h % 10 == 0) & (n > 0), joined[0]).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = periodic_runs(docs).withColumn("best", best)
    start, period = -F.col("best.back"), -F.col("best.short")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), start.alias("start"), F.col("best.length").alias("length"), period.alias("period"),
        F.expr("(1000 * best.length) DIV (-best.short)").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
