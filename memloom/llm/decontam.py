"""Benchmark decontamination: documents that hold a benchmark item with few word edits.

1. Runs of words that an item must share with any near copy of it (pigeonhole) point
   at item-sized windows of the documents.
2. Windows and items are walked by the CGK embedding: at each step the walk puts out the word
   it stands on and a hashed bit of (step, word) says whether it moves on. Few edits
   become few unlike places.
3. Some places of the walk, drawn anew in each of many repetitions, make a key; a window
   meets the items that share a key in any repetition.
4. The exact word edit distance between the item and the best stretch around the window decides.

Items are searched in blocks of bounded size, each broadcast and held against all documents.
"""

from __future__ import annotations

import math
import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.textio import in_batches, pieces, plain, ragged, table, words

#: Edits a near copy may have, as a share of the item's words.
MOST_EDITS = 0.2
#: Documents are not dropped for items of fewer words: those say too little to tell a leak from chance.
LEAST_WORDS = 5
GRAM = 3
#: Places sampled for one key, and the share of near copies at the edit limit to be met.
PLACES, RECALL = 2, 0.99
#: Share of unlike places that ``MOST_EDITS`` makes in a walk, at the worst.
UNLIKE = 0.6
#: Items of one block, and characters of one: what is broadcast at once.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 32 << 20
_EDGES = string.punctuation + "«»“”„…¡¿"


def bare(word: str) -> str:
    return word.strip(_EDGES).lower()


def repetitions(places: int = PLACES, recall: float = RECALL, unlike: float = UNLIKE) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - unlike) ** places))


def most_edits(n: int, share: float = MOST_EDITS) -> int:
    return int(share * n + 1e-9)


def edits_within(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance between ``item`` and any stretch of ``text``, and where the first such
    stretch ends; by bit vectors over the item's words."""
    n = len(item)
    masks: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item):
        masks[w] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best, end = full, 0, n, n, 0
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        plus, minus = (down | ~(d0 | up)) & full, up & d0
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = (minus | ~(d0 | plus)) & full, plus & d0
        if score < best:
            best, end = score, j
    return best, end


class Items:
    """One block of items, ready to be searched for."""

    def __init__(self, rows: list[tuple[int, str]], share: float = MOST_EDITS, places: int = PLACES, recall: float = RECALL, seed: int = 11, least_words: int = 1):
        self.share, self.places, self.reps = share, places, repetitions(places, recall)
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int] = []
        self.words: list[list[int]] = []
        for item_id, text in rows:
            kept = [b for b in map(bare, (text or "").split()) if b]
            if len(kept) >= max(1, least_words):
                self.ids.append(item_id)
                self.words.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in kept])
        self.base = len(self.vocabulary) + 1
        rng = np.random.default_rng(seed)
        self.salts = rng.integers(1, 1 << 63, size=self.reps, dtype=np.uint64) | np.uint64(1)
        grams: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for x in self.words:
            q = self.gram_of(len(x))
            for o in range(len(x) - q + 1):
                grams[self._key(x[o : o + q])].add((o, len(x)))
        self.sizes = sorted({self.gram_of(len(x)) for x in self.words})
        self.grams = np.array(sorted(grams), dtype=np.uint64)
        spots = [sorted(grams[g]) for g in self.grams.tolist()]
        self.spot_ends = np.concatenate([[0], np.cumsum([len(s) for s in spots])]).astype(np.int64)
        self.spots = np.array([p for s in spots for p in s], dtype=np.int64).reshape(-1, 2)
        self.sampled = {n: rng.integers(0, 3 * n, size=(self.reps, places)) for n in sorted({len(x) for x in self.words})}
        self.tables: dict[tuple[int, int], dict[int, list[int]]] = {}
        for n in self.sampled:
            own = [i for i, x in enumerate(self.words) if len(x) == n]
            keys = self.keys(np.array([self.words[i] for i in own], dtype=np.int64), n)
            for r in range(self.reps):
                found: dict[int, list[int]] = defaultdict(list)
                for i, k in zip(own, keys[:, r].tolist(), strict=True):
                    found[k].append(i)
                self.tables[n, r] = dict(found)

    def gram_of(self, n: int) -> int:
        """Words of the longest run, up to GRAM, that a near copy of n words must share."""
        k = most_edits(n, self.share)
        return max(1, min(GRAM, -(-(n - k) // (k + 1))))

    def _key(self, gram: list[int]) -> int:
        key = 0
        for w in gram:
            key = ((key ^ w) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) + 1
        return key & (1 << 64) - 1

    def keys(self, windows: np.ndarray, n: int) -> np.ndarray:
        """Keys of ``windows`` (one of n words a row) in each repetition: walks of 3n steps."""
        count, steps = len(windows), 3 * n
        padded = np.concatenate([windows, np.full((count, 1), self.base, dtype=np.int64)], axis=1)
        wanted = self.sampled[n]
        at = np.zeros((count, self.reps), dtype=np.int64)
        out = np.zeros((count, self.reps), dtype=np.uint64)
        rows = np.arange(count)[:, None]
        last = int(wanted.max(initial=0))
        for step in range(min(steps, last + 1)):
            word = padded[rows, at].astype(np.uint64)
            for place in range(self.places):
                take = wanted[:, place] == step
                if take.any():
                    out[:, take] = (out[:, take] ^ (word[:, take] + np.uint64(1 + (place << 40)))) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (word + np.uint64(step + 1) * self.salts[None, :]) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            at = np.minimum(at + ((mixed * self.salts[None, :]) >> np.uint64(63)).astype(np.int64), n)
        return out

    def windows(self, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Distinct (row, first word, words) of windows that a shared run points at."""
        found = []
        for q in self.sizes:
            if len(ids) < q or not len(self.grams):
                continue
            ok = ids[: len(ids) - q + 1] > 0
            for k in range(1, q):
                ok &= ids[k : len(ids) - q + 1 + k] > 0
            ok &= owner[: len(ids) - q + 1] == owner[q - 1 :]
            at = np.flatnonzero(ok)
            key = np.zeros(len(at), dtype=np.uint64)
            for k in range(q):
                key = (key ^ ids[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
            place = np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)
            hit = self.grams[place] == key
            at, place = at[hit], place[hit]
            many = self.spot_ends[place + 1] - self.spot_ends[place]
            spot = self.spots[ragged(self.spot_ends[place], many)]
            starts = np.repeat(at, many)
            same = np.array([self.gram_of(n) == q for n in spot[:, 1].tolist()], dtype=bool) if len(spot) else np.zeros(0, dtype=bool)
            found.append(np.stack([owner[starts], starts - spot[:, 0], spot[:, 1]], axis=1)[same])
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), dtype=np.int64)

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item id, edits, words up to the end of the stretch) of each near copy."""
        codes, offsets, distinct = words(texts)
        own = np.array([self.vocabulary.get(b, 0) if (b := bare(w)) else -1 for w in distinct.to_pylist()], dtype=np.int64)
        ids = own[codes]
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        kept = ids >= 0
        ids, owner = ids[kept], owner[kept]
        begins = np.searchsorted(owner, np.arange(len(offsets)))
        windows = self.windows(ids, owner)
        found: dict[tuple[int, int], list[int]] = defaultdict(list)
        for n in self.sampled:
            mine = windows[windows[:, 2] == n]
            for part in range(0, len(mine), 50_000):
                self._meet(mine[part : part + 50_000], n, ids, begins, found)
        out = []
        for (row, item), starts in found.items():
            n, k = len(self.words[item]), most_edits(len(self.words[item]), self.share)
            best = (k + 1, 0)
            for first, last in _merged(sorted(starts), n, k):
                first, last = max(first, int(begins[row])), min(last, int(begins[row + 1]))
                edits, end = edits_within(self.words[item], ids[first:last].tolist())
                best = min(best, (edits, first + end - int(begins[row])))
            if best[0] <= k:
                out.append((row, self.ids[item], best[0], best[1]))
        return sorted(out)

    def _meet(self, mine: np.ndarray, n: int, ids: np.ndarray, begins: np.ndarray, found: dict) -> None:
        place = mine[:, 1][:, None] + np.arange(n)[None, :]
        inside = (place >= begins[mine[:, 0]][:, None]) & (place < begins[mine[:, 0] + 1][:, None])
        window = np.where(inside, ids[np.clip(place, 0, max(len(ids) - 1, 0))] if len(ids) else 0, 0)
        if not len(window):
            return
        keys = self.keys(window, n)
        for r in range(self.reps):
            known = self.tables[n, r]
            hit = np.isin(keys[:, r], np.fromiter(known, dtype=np.uint64, count=len(known)))
            for i in np.flatnonzero(hit):
                for item in known[int(keys[i, r])]:
                    spots = found[int(mine[i, 0]), item]
                    if not spots or spots[-1] != mine[i, 1]:
                        spots.append(int(mine[i, 1]))


def _merged(starts: list[int], n: int, k: int) -> Iterator[tuple[int, int]]:
    """Stretches around windows of n words that begin at ``starts``, k words wider each way."""
    first, last = starts[0] - k, starts[0] + n + k
    for s in starts[1:]:
        if s - k > last:
            yield first, last
            first = s - k
        last = max(last, s + n + k)
    yield first, last


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = MOST_EDITS, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS, least_words: int = 1) -> DataFrame:
    """doc_id, item_id, edits, item_words, end_word: an item near-copied in a document, once for each row of ``docs``.

    Words are compared without case and edge punctuation. Null and empty texts hold
    nothing; items without words, of fewer than ``least_words``, or null are not looked for; equal items are found each.
    Short items leave no room for edits and are found where they occur as they are: item_words lets a caller decide about them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = [in_batches(docs.select("doc_id", "text"), _searcher(shared), f"doc_id {kind}, item_id bigint, edits int, item_words int, end_word bigint")
             for shared in _blocks(docs.sparkSession, benchmark, share, block_items, block_chars, least_words)]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def _blocks(spark: SparkSession, benchmark: DataFrame, share: float, block_items: int, block_chars: int, least_words: int) -> Iterator:
    """Broadcasts of all items, in blocks of bounded size."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text")).where("text IS NOT NULL")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-chars // block_chars))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield spark.sparkContext.broadcast(Items(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is not None, r)), share, least_words=least_words))


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = MOST_EDITS, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` (text and any other columns) that hold no near copy of an item of ``least_words``, in its columns.

    Null and empty texts hold nothing and stay, as all rows do where ``benchmark`` is empty; repeated rows go or stay together."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    text = names[[c.lower() for c in docs.columns].index("text")] if "text" not in docs.columns else names[docs.columns.index("text")]
    rows = docs.toDF(*names)
    for shared in _blocks(docs.sparkSession, benchmark, share, block_items, block_chars, least_words):
        rows = in_batches(rows, _cleaner(shared, text), rows.schema)
    return rows.toDF(*docs.columns)


def _cleaner(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                kept = np.ones(piece.num_rows, dtype=bool)
                kept[[h[0] for h in shared.value.search(plain(piece.column(text)))]] = False
                yield piece.filter(pa.array(kept))

    return run


def _searcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        size = {i: len(w) for i, w in zip(items.ids, items.words, strict=True)}
        for batch in batches:
            for piece in pieces(batch, "text"):
                hits = items.search(plain(piece.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64())), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int32()),
                     pa.array([size[h[1]] for h in hits], pa.int32()), pa.array([h[3] for h in hits], pa.int64())],
                    names=["doc_id", "item_id", "edits", "item_words", "end_word"])

    return run


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
