"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed words and word beginnings. Its score is the logistic of a bias, a weight a
term and, for each pair of terms, the product of their factor vectors: pairs such as an
insult with a group mention count more, or less, than their terms alone.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.textio import crc_mod, in_batches, pieces, plain, table, words

BUCKETS = 1 << 20
#: The machine is fitted on a bounded sample: about so many rows of each label.
SAMPLE_ROWS = 6000
#: And of about so many characters in all.
SAMPLE_CHARS = 64 << 20
#: Hashed terms it has weights for: those most telling of the label in the sample.
TERMS = 2048
#: They are in so many sample rows, and so many standard deviations from the mean share of the label.
LEAST_SEEN, LEAST_Z = 4, 5.0
FACTORS = 8
THRESHOLD = 0.3
#: Lengths of word beginnings that are terms too.
PREFIXES = (4, 5, 6)
_EDGES = string.punctuation + "«»“”„…¡¿"


def term_ids(distinct: list[str]) -> np.ndarray:
    """Hash buckets of each word, stripped of punctuation and lower-cased, and of its first
    letters (inflected forms share them); -1 where there is nothing."""
    found = np.full((len(distinct), 1 + len(PREFIXES)), -1, dtype=np.int64)
    for i, word in enumerate(distinct):
        bare = word.strip(_EDGES).lower()
        if bare:
            found[i, 0] = zlib.crc32(bare.encode()) % BUCKETS
            for k, n in enumerate(PREFIXES, 1):
                if len(bare) > n:
                    found[i, k] = zlib.crc32(f"{bare[:n]}-".encode()) % BUCKETS
    return found


def features(texts: pa.Array, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs: hash buckets, or places in the sorted array ``chosen``."""
    codes, offsets, distinct = words(texts)
    ids = term_ids(distinct.to_pylist())
    if chosen is not None:
        at = np.minimum(np.searchsorted(chosen, ids), max(len(chosen) - 1, 0))
        ids = np.where(chosen[at] == ids, at, -1) if len(chosen) else np.full_like(ids, -1)
    width = BUCKETS if chosen is None else max(len(chosen), 1)
    telling = (ids >= 0).any(axis=1)[codes]
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[telling]
    hits = ids[codes[telling]]
    pairs = np.unique((rows[:, None] * width + hits)[hits >= 0])
    return pairs // width, pairs % width


class FactorizationMachine:
    def __init__(self, chosen: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.chosen, self.bias, self.weights, self.factors = chosen, bias, weights, factors

    @classmethod
    def fit(cls, terms: list[np.ndarray], labels: np.ndarray, steps: int = 250, rate: float = 0.05, decay: float = 2e-4, seed: int = 5) -> FactorizationMachine:
        """Full-batch Adam on the mean logistic loss over binary term sets."""
        positive = max(int(labels.sum()), 0)
        if not len(terms) or positive in (0, len(terms)):  # one label, or none: that label's share
            share = (positive + 0.5) / (len(terms) + 1)
            return cls(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
        flat = np.concatenate(terms).astype(np.int64)
        owner = np.repeat(labels, [len(t) for t in terms])
        seen = np.bincount(flat, minlength=BUCKETS)
        toxic = np.bincount(flat, weights=owner, minlength=BUCKETS)
        base = positive / len(terms)
        telling = np.where(seen >= LEAST_SEEN, np.abs(toxic - seen * base) / np.sqrt(np.maximum(seen, 1) * base * (1 - base)), 0.0)
        chosen = np.sort(np.argsort(-telling, kind="stable")[:TERMS])
        chosen = chosen[telling[chosen] >= LEAST_Z]
        x = np.zeros((len(terms), len(chosen)), dtype=np.float32)
        for i, t in enumerate(terms):
            x[i, np.searchsorted(chosen, t[np.isin(t, chosen)])] = 1.0
        y = labels.astype(np.float32)
        rng = np.random.default_rng(seed)
        params = [np.array([np.log(base / (1 - base))], np.float32), np.zeros(len(chosen), np.float32), rng.normal(0, 0.02, (len(chosen), FACTORS)).astype(np.float32)]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            bias, w, v = params
            s = x @ v
            z = bias[0] + x @ w + 0.5 * ((s * s).sum(1) - x @ (v * v).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
            xg = x.T @ g
            grads = [np.array([g.sum()], np.float32), xg + decay * w, x.T @ (s * g[:, None]) - v * xg[:, None] + decay * v]
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                params[k] = params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return cls(chosen, float(params[0][0]), params[1], params[2])

    def score(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        rows, terms = features(texts, self.chosen)
        linear = np.bincount(rows, weights=self.weights[terms] if len(terms) else None, minlength=n)[:n]
        pairs = np.zeros(n)
        for k in range(FACTORS):
            v = self.factors[terms, k].astype(np.float64) if len(terms) else None
            s = np.bincount(rows, weights=v, minlength=n)[:n]
            pairs += s * s - (np.bincount(rows, weights=v * v, minlength=n)[:n] if len(terms) else 0)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + 0.5 * pairs, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Fit on a hash-drawn sample of the labelled rows of ``docs`` (doc_id, text): about
    ``sample_rows`` of each label, of SAMPLE_CHARS characters in all. Rows without a label or doc_id teach nothing."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    sizes = {r.label: r.n for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.lit(0.0)
    for label, n in sizes.items():
        rate = F.when(F.col("label") == label, F.lit(min(1.0, sample_rows / n))).otherwise(rate)
    # At most about two times sample_rows pairs of two numbers, so they may be broadcast.
    drawn = F.broadcast(marked.where(draw < rate))
    rows = docs.select("doc_id", "text").join(drawn, "doc_id").select("text", "label")
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    thin = min(1.0, SAMPLE_CHARS / max(chars, 1))
    if thin < 1:  # long texts, or many rows of one doc_id: fewer of both labels
        rows = rows.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)) < thin * (1 << 30))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                owner, terms = features(plain(piece.column("text")))
                ends = np.searchsorted(owner, np.arange(piece.num_rows + 1))
                data = terms.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([data[ends[i] : ends[i + 1]].tobytes() for i in range(piece.num_rows)], pa.binary()), piece.column("label")], names=["terms", "label"])

    sample = in_batches(rows, sets, "terms binary, label int").collect()
    sample.sort(key=lambda r: (r.label, r.terms))
    machine = FactorizationMachine.fit([np.frombuffer(r.terms, "<u4") for r in sample], np.array([r.label for r in sample], dtype=np.float64))
    # The sample holds labels at its own shares; the bias goes back to those of all labelled rows.
    kept = [sizes.get(k, 0) and min(1.0, sample_rows / sizes[k]) for k in (0, 1)]
    if all(kept):
        machine.bias += float(np.log(kept[0] / kept[1]))
    return machine


def score(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """doc_id, score of ``docs`` (doc_id, text); null and empty texts have the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(shared.value.score(plain(piece.column("text"))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns where crc32(doc_id) mod 4 is not 2 and scores every row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    machine = fit(docs, labels.where(crc_mod(F.col("doc_id"), 4) != 2))
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return score(docs, machine).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
