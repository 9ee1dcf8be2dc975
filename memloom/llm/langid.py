"""Language identification by interpolated Kneser-Ney character models.

Words are lower-cased letter runs between word-start and word-end marks; a model gives
each character a probability from the ``ORDER - 1`` before it in its word. All languages
share one sorted array of n-gram hashes an order, with a column of weights a language.
The language of least cross-entropy a character wins. Documents whose cross-entropy lies
beyond what held-out rows of any language showed are rejected.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.textio import crc_mod, in_batches, pieces, plain, row_sums, table, words

ORDER = 4
#: The model is fitted on a bounded sample: about so many characters a language.
SAMPLE_CHARS = 1_500_000
#: Languages whose rates are broadcast.
MOST_BROADCAST = 10_000
#: Of the sample, one row in so many calibrates the score and the rejection.
CALIBRATION = 5
#: Rejection: so many times the deviation that this share of calibration rows keeps within, in units of what a text of that length
#: deviates by; and the least that texts of any length differ by, in bits a character.
MARGIN, WITHIN, LEAST_SPREAD = 3.0, 0.99, 0.05
START, END = 1, 2
#: Text bytes scored at once.
PIECE = 1 << 19


def letters(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalpha())


def _codes(kept: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``kept`` with ORDER - 1 starts before and one end after each; where words begin."""
    sizes = np.array([len(w) for w in kept], dtype=np.int64) + ORDER
    flat = np.frombuffer("".join(kept).encode("utf-32-le"), dtype="<u4").astype(np.uint64) + 3
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(int(begins[-1]), START, dtype=np.uint64)
    place = np.ones(len(out), dtype=bool)
    for k in range(ORDER - 1):
        place[begins[:-1] + k] = False
    place[begins[1:] - 1] = False
    out[place] = flat
    out[begins[1:] - 1] = END
    return out, begins


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _grams(codes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each place, for n from 1 to ORDER."""
    found = [codes * _BASE + np.uint64(1)]
    for n in range(2, ORDER + 1):
        back = np.zeros_like(codes)
        back[n - 1 :] = codes[: len(codes) - n + 1]
        found.append((found[-1] ^ (back + np.uint64(n))) * np.uint64(0x100000001B3) + (found[-1] >> np.uint64(29)))
    return found


class LanguageModel:
    """For n in 1..ORDER: sorted hashes, weight of the n-gram a language; and of
    contexts: sorted hashes, weight of the shorter model a language."""

    def __init__(self, counts: dict[str, Counter]):
        self.languages = sorted(counts)
        shape = len(self.languages)
        parts: list[dict[int, np.ndarray]] = [defaultdict(lambda: np.zeros(shape, np.float32)) for _ in range(ORDER)]
        lower: list[dict[int, np.ndarray]] = [defaultdict(lambda: np.ones(shape, np.float32)) for _ in range(ORDER)]
        alphabet = {c for x in counts.values() for w in x for c in w}
        self.floor = 1.0 / (len(alphabet) + 2)
        for j, language in enumerate(self.languages):
            self._fit(counts[language], j, parts, lower)
        self.grams = [self._sorted(x, shape) for x in parts]
        self.contexts = [self._sorted(x, shape) for x in lower]

    @staticmethod
    def _sorted(found: dict, shape: int) -> tuple[np.ndarray, np.ndarray]:
        keys = np.fromiter(found, dtype=np.uint64, count=len(found))
        order = np.argsort(keys)
        values = np.array([found[k] for k in found], dtype=np.float32).reshape(len(found), shape)
        return keys[order], values[order]

    def _fit(self, words_: Counter, j: int, parts: list, lower: list) -> None:
        kept = sorted(words_)
        codes, begins = _codes(kept)
        weight = np.repeat(np.array([words_[w] for w in kept], dtype=np.int64), np.diff(begins))
        hashes = _grams(codes)
        inner = np.ones(len(codes), dtype=bool)
        for k in range(ORDER - 1):
            inner[begins[:-1] + k] = False
        # Count of each n-gram; below the highest order, of the distinct n-grams that extend it to the left.
        at = np.flatnonzero(inner)
        keys, index = np.unique(hashes[ORDER - 1][at], return_index=True)
        where = at[index]
        tally = np.bincount(np.searchsorted(keys, hashes[ORDER - 1][at]), weights=weight[at])
        for n in range(ORDER, 0, -1):
            ones, twos = int((tally == 1).sum()), int((tally == 2).sum())
            discount = ones / (ones + 2 * twos) if ones else 0.5
            # At order 1 the context is empty: one group with hash 0.
            context = hashes[n - 2][where - 1] if n > 1 else np.zeros(len(where), dtype=np.uint64)
            groups, member = np.unique(context, return_inverse=True)
            total = np.bincount(member, weights=tally)
            kinds = np.bincount(member)
            for k, p in zip(keys.tolist(), (np.maximum(tally - discount, 0) / total[member]).tolist(), strict=True):
                parts[n - 1][k][j] = p
            for g, p in zip(groups.tolist(), (discount * kinds / total).tolist(), strict=True):
                lower[n - 1][g][j] = p
            if n > 1:
                shorter, index, member = np.unique(hashes[n - 2][where], return_index=True, return_inverse=True)
                keys, where, tally = shorter, where[index], np.bincount(member).astype(np.float64)

    @staticmethod
    def _look(arrays: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
        known, values = arrays
        if not len(known):
            return np.full((len(keys), values.shape[1]), missing, dtype=np.float32)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        found = values[at]
        found[known[at] != keys] = missing
        return found

    def word_costs(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """-log2 probability of each word by language, and its characters with the end mark (0: no letter)."""
        kept = [letters(w) for w in distinct]
        full = np.array([len(w) > 0 for w in kept], dtype=bool)
        costs, sizes = np.zeros((len(kept), len(self.languages))), np.zeros(len(kept), dtype=np.int64)
        some = [w for w in kept if w]
        if some:
            codes, begins = _codes(some)
            hashes = _grams(codes)
            inner = np.ones(len(codes), dtype=bool)
            for k in range(ORDER - 1):
                inner[begins[:-1] + k] = False
            at = np.flatnonzero(inner)
            p = self._look(self.contexts[0], np.zeros(1, dtype=np.uint64), 1.0) * self.floor
            p = self._look(self.grams[0], hashes[0][at], 0.0) + p
            for n in range(2, ORDER + 1):
                p = self._look(self.grams[n - 1], hashes[n - 1][at], 0.0) + self._look(self.contexts[n - 1], hashes[n - 2][at - 1], 1.0) * p
            sizes[full] = np.diff(begins) - (ORDER - 1)
            costs[full] = row_sums(-np.log2(np.maximum(p, 1e-9)), np.concatenate([[0], np.cumsum(sizes[full])]))
        return costs, sizes

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character by language, and characters, of each text."""
        codes, offsets, distinct = words(texts)
        costs, sizes = self.word_costs(distinct.to_pylist())
        n = row_sums(sizes[codes].astype(np.float64), offsets)
        return row_sums(costs[codes], offsets) / np.maximum(n, 1)[:, None], n


class Identifier:
    """A language model with calibrated score and rejection."""

    def __init__(self, rows: list[tuple[str, str]]):
        counts: dict[str, Counter] = defaultdict(Counter)
        held = [r for i, r in enumerate(rows) if i % CALIBRATION == 0 and len(rows) > 10 * CALIBRATION]
        learned = [r for i, r in enumerate(rows) if i % CALIBRATION or not held]
        for language, text in learned:
            counts[language].update(w for w in map(letters, text.split()) if w)
        self.model = LanguageModel({k: v for k, v in counts.items() if v})
        self.scale, self.most = 1.0, np.inf
        self.centres = np.zeros(len(self.model.languages))
        self.between, self.per_letter = LEAST_SPREAD**2, 0.0
        if held and self.model.languages:
            place = {x: i for i, x in enumerate(self.model.languages)}
            entropy, n = self.model.entropies(pa.array([t for _, t in held], pa.string()))
            truth = np.array([place.get(x, -1) for x, _ in held])
            use = (n > 0) & (truth >= 0)
            if use.any():
                entropy, n, truth = entropy[use], n[use], truth[use]
                losses = []
                for scale in (grid := 2.0 ** np.arange(-3, 6)):
                    p = self._posterior(entropy, n, scale)
                    losses.append(-np.log(np.maximum(p[np.arange(len(p)), truth], 1e-12)).mean())
                self.scale = float(grid[int(np.argmin(losses))])
                self._calibrate(entropy[np.arange(len(truth)), truth], n, truth)

    def _calibrate(self, own: np.ndarray, n: np.ndarray, truth: np.ndarray) -> None:
        """What entropies a text of each language has, given its length: a mean a language, and a variance of a + b / letters. The first part
        does not vanish with length: two long texts of one language still differ."""
        middle = {j: float(np.median(own[truth == j])) for j in np.unique(truth).tolist()}
        self.centres = np.array([middle.get(j, float(np.median(own))) for j in range(len(self.model.languages))])
        square = (own - self.centres[truth]) ** 2
        short = n <= np.median(n)
        self.per_letter = float(np.median(square[short] * n[short]) / 0.455)  # the median of a squared standard normal
        rest = square[~short] - self.per_letter / n[~short] if (~short).any() else np.zeros(1)
        self.between = max(LEAST_SPREAD**2, float(np.mean(rest)))
        self.most = MARGIN * max(1.0, float(np.quantile(self._deviation(own, n, truth), WITHIN)))

    def _deviation(self, entropy: np.ndarray, n: np.ndarray, language: np.ndarray) -> np.ndarray:
        return (entropy - self.centres[language]) / np.sqrt(self.between + self.per_letter / np.maximum(n, 1))

    @staticmethod
    def _posterior(entropy: np.ndarray, n: np.ndarray, scale: float) -> np.ndarray:
        z = -entropy * (np.sqrt(n) * scale)[:, None]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language ("und": no letter), score, least cross-entropy and whether to reject."""
        if not self.model.languages:
            n = len(texts)
            return np.full(n, "und", dtype=object), np.zeros(n), np.zeros(n), np.ones(n, dtype=bool)
        entropy, n = self.model.entropies(texts)
        best = entropy.argmin(axis=1)
        least = entropy.min(axis=1)
        score = self._posterior(entropy, n, self.scale).max(axis=1)
        names = np.array(self.model.languages, dtype=object)[best]
        names[n == 0], score[n == 0], least[n == 0] = "und", 0.0, 0.0
        return names, score, least, (n == 0) | (self._deviation(least, n, best) > self.most)


def fit(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Identifier:
    """Fit on a hash-drawn sample of ``labelled`` (text, lang), about ``sample_chars`` a language; of copies
    of a text, which are drawn together, one is learned. Null texts and langs teach nothing."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.length("text").alias("chars"))
    rates = rows.groupBy("lang").agg((F.lit(float(sample_chars)) / F.greatest(F.sum("chars"), F.lit(1))).alias("rate"))
    draw = F.pmod(F.xxhash64("text", F.lit(8)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = rates.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    drawn = rows.join(F.broadcast(rates) if few else rates, "lang").where(draw < F.col("rate"))
    sample = drawn.select("lang", "text").dropDuplicates().collect()
    return Identifier(sorted((r.lang, r.text) for r in sample))


def identify(docs: DataFrame, identifier: Identifier, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred, score, entropy, rejected. Texts that are null
    or have no letter: und, score 0, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(identifier)
    chosen = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], F.col("text").alias("__text"))
    kept = chosen.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "__text", PIECE):
                names, score, least, rejected = shared.value.predict(plain(piece.column("__text")))
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in kept], pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(least), pa.array(rejected)],
                    names=[*kept, "__lang", "__score", "__entropy", "__rejected"])

    types = [f"`{k}` {chosen.schema[k].dataType.simpleString()}" for k in kept]
    out = in_batches(chosen, run, ", ".join([*types, "__lang string, __score double, __entropy double, __rejected boolean"]))
    return out.toDF(*keep, "lang_pred", "score", "entropy", "rejected")


def accepted(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """The rows of ``docs`` that are not rejected, in its columns; a null lang becomes the one predicted.

    Null texts and texts without a letter are rejected; of an identifier that has learned nothing, all rows are."""
    out = identify(docs, identifier, docs.columns)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    found = out.toDF(*names, "__lang", "__score", "__entropy", "__rejected").where("NOT __rejected")
    return found.select(*[(F.coalesce(F.col(n), F.col("__lang")) if c == "lang" else F.col(n)).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns where crc32(doc_id) mod 5 is not 0 (null doc_id: never) and predicts every row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    identifier = fit(docs.where(crc_mod(F.col("doc_id"), 5) != 0))
    out = identify(docs.select("doc_id", "text"), identifier, ["doc_id"])
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
