"""Exact n-gram Jaccard join of documents, and its connected components.

1. Each text becomes the sorted array of its distinct shingle hashes. Texts with equal sets
   are one class, whose rows are counted and for which one set goes on.
2. Shingles are ordered by how often they recur, then by hash. The first shingle that two sets of
   similarity t share is among the first n - ceil(t * n) + 1 of each, so sets meet in buckets by those;
   in the smaller set it is among the first n - ceil(2 * t / (1 + t) * n) + 1, marked ``early``.
3. In each bucket every set is held against the bucket's first set, which is linear in the bucket.
4. Buckets that still hold sets of several components are cut into tiles by size band
   (similar sets lie in the same or the next band) and hash. Inside two tiles, bit counts of
   hashed bitmaps bound the overlap from above.
5. Sets of pairs that the bound lets through, in 3 and in 4, form blocks. Inside a block every pair
   that size and bitmaps let through is decided by intersecting arrays, once, and counted for both sets.

No pair of sets at or over the threshold is missed: the prefixes, bands and bitmaps only rule out
pairs that cannot reach it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.llm.components import components
from memloom.llm.textio import WordHash, delete_stored, free_shuffles, in_batches, join_sums, pieces, ragged, stored, table, words

WORDS = 5
#: The threshold as a fraction: 100 * intersection >= 75 * union.
NUMERATOR, DENOMINATOR = 75, 100
#: Shingles found at least so often are ordered last, by count. Only the most frequent
#: MOST_HOT are told apart: the order makes the join faster or slower, never wrong.
HOT, MOST_HOT = 6, 400_000
COUNTED_AT_ONCE = 1 << 20
#: Text bytes made into sets at once.
PIECE = 2 << 20
#: Rows of wanted sets that are broadcast to where the sets lie; more are joined by a shuffle.
MOST_BROADCAST = 300_000
#: Sets of one bucket that one task leads.
SPLIT = 100_000
#: Sets held against one copy of a bucket's first set; and sets of one tile.
GROUP, TILE = 4096, 512
#: Sets, and shingles, of one tile of a block.
BLOCK_SETS, BLOCK_SHINGLES = 4096, 3 << 20
MOST_BITS = 8192


def shingle_sets(texts: pa.Array, hasher: WordHash) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    codes, offsets, distinct = words(texts)
    word = hasher(distinct)[0][codes]
    n = len(word)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        mixed[: max(0, n - k)] = (mixed[: max(0, n - k)] ^ word[k:]) * np.uint64(0x9E3779B97F4A7C15)
        mixed[: max(0, n - k)] ^= mixed[: max(0, n - k)] >> np.uint64(29)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(mixed[a : b - WORDS + 1]))
        elif b > a:
            digest = hashlib.blake2b(word[a:b].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(digest, dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1 if n else 0


def early_length(n: np.ndarray) -> np.ndarray:
    """How many of a set's first shingles can be the first that it shares with a similar set of its size or larger."""
    return n - -(-2 * NUMERATOR * n // (DENOMINATOR + NUMERATOR)) + 1


def can_meet(n, early, m, others):
    """False where a bucket's shingle can't be the first that two similar sets share: the smaller one has it too late."""
    return ((n > m) | early) & ((m > n) | others)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def near_in_size(a, b):
    return DENOMINATOR * np.minimum(a, b) >= NUMERATOR * np.maximum(a, b)


def _edges() -> np.ndarray:
    found = [1]
    while found[-1] < 1 << 40:
        found.append(found[-1] * DENOMINATOR // NUMERATOR + 1)
    return np.array(found, dtype=np.int64)


EDGES = _edges()


def band(n):
    """Size band: sets that can be similar differ by one band at most (a band spans the factor 4/3)."""
    return np.searchsorted(EDGES, n, side="right") - 1


def bits_for(n: int) -> int:
    return min(MOST_BITS, 64 << max(0, (2 * n - 1).bit_length() - 6))


def bitmap(hashes: np.ndarray, width: int = 0) -> np.ndarray:
    width = width or bits_for(len(hashes))
    bits = np.zeros(width, dtype=np.uint8)
    bits[(hashes % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(maps: np.ndarray, width: int) -> np.ndarray:
    """Narrow bitmaps to ``width`` words: position modulo a power of two stays right."""
    while maps.shape[-1] > width:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] | maps[..., half:]
    return maps


def could_be_similar(n: np.ndarray, maps: np.ndarray, m: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each set of the first tile and the second: unlike bits are unlike shingles, so
    the overlap is at most (n + m - unlike) / 2. False where that is too little."""
    unlike = np.bitwise_count(maps[:, None, :] ^ others[None, :, :]).sum(axis=2, dtype=np.int64)
    total = n[:, None] + m[None, :]
    most = (total - unlike) // 2
    return near_in_size(n[:, None], m[None, :]) & (DENOMINATOR * most >= NUMERATOR * (total - most))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"), F.col("text").alias("text"))


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


SCANNED = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("hash", pa.int64()), ("seen", pa.int64())])


def scan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, k1, k2 (a key of the text), n, digest (null: empty set) of every row, stored; and hash, n of shingles that recur often.

    A task counts some millions of shingles at once and passes on those that more than one set holds; so one in more
    sets than there are such lots is always found."""

    def recurring(held: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        ends = np.flatnonzero(np.append(flat[1:] != flat[:-1], True)) if len(flat) else np.zeros(0, np.int64)
        counts = np.diff(ends, prepend=-1)
        again = counts > 1
        none = [pa.nulls(int(again.sum()), t) for t in SCANNED.types[:5]]
        return pa.RecordBatch.from_arrays([*none, pa.array(flat[ends[again]].view(np.int64)), pa.array(counts[again].astype(np.int64))], schema=SCANNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size, seen = WordHash(), [], 0, set()
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                sets = shingle_sets(piece.column("text"), hasher)
                digests = [_digest(s) for s in sets]
                none = [pa.nulls(len(sets), pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in ("doc_id", "k1", "k2")], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), *none], schema=SCANNED)
                for s, d in zip(sets, digests, strict=True):
                    if d is not None and d not in seen:
                        seen.add(d)
                        held.append(s)
                        size += len(s)
                if size >= COUNTED_AT_ONCE:
                    yield recurring(held)
                    held, size, seen = [], 0, set()
        yield recurring(held)

    found = stored(in_batches(_keyed(docs), run, "doc_id bigint, k1 bigint, k2 bigint, n bigint, digest binary, hash bigint, seen bigint"), "scanned")
    counts = found.where("hash IS NOT NULL").groupBy("hash").agg(F.sum("seen").alias("n")).where(F.col("n") >= HOT)
    rows = found.where("hash IS NULL").select("doc_id", "k1", "k2", "n", "digest")
    rows.stored_at = found.stored_at
    return rows, counts


def hot_shingles(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and counts, of the MOST_HOT most frequent shingles."""
    top = counts.orderBy(F.desc("n"), "hash").limit(MOST_HOT).toArrow()
    keys = top.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top.column("n").to_numpy()[order]


def prefix_of(hashes: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order: rare ones first, then by hash."""
    take = prefix_length(len(hashes))
    if len(keys) and take < len(hashes):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        weight = np.where(keys[at] == hashes, counts[at], 0)
        if weight.any():
            hashes = hashes[np.lexsort((hashes, weight))]
    return hashes[:take]


def first_sets(docs: DataFrame, hot) -> DataFrame:
    """rid, digest, k1, k2, n, prefix, bits of one row for each set that is not empty, stored. ``rid`` numbers the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHash(), set()
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                sets = shingle_sets(piece.column("text"), hasher)
                fresh, digests = [], []
                for i, s in enumerate(sets):
                    d = _digest(s)
                    if d is not None and d not in seen:
                        seen.add(d)
                        fresh.append(i)
                        digests.append(d)
                kept = [sets[i] for i in fresh]
                one = piece.take(pa.array(fresh, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), one.column("k1"), one.column("k2"), pa.array([len(s) for s in kept], pa.int64()), pa.array([prefix_of(s, *hot.value).tobytes() for s in kept], pa.binary()),
                     pa.array([bitmap(s).tobytes() for s in kept], pa.binary())], names=["digest", "k1", "k2", "n", "prefix", "bits"])

    # A task passes on a set once, so a set that many rows have comes once from each task.
    rows = in_batches(_keyed(docs).select("k1", "k2", "text"), run, "digest binary, k1 bigint, k2 bigint, n bigint, prefix binary, bits binary")
    return stored(rows.repartition("digest").dropDuplicates(["digest"]).select(F.monotonically_increasing_id().alias("rid"), "*"), "firsts", "none")


def bucket_members(sets: DataFrame, hot) -> DataFrame:
    """hash, leader, rid, n, early, band, near, crowd: each further set of a bucket, with the bucket's first. ``near``: sizes and
    places of the shingle allow a link; ``crowd``: the bucket may hold more sets than these two. Buckets of one set are gone. A bucket of more than SPLIT sets, by
    the counts ``hot``, is dealt over parts with a first set each, which are members themselves."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = hot.value
        large = counts > SPLIT
        keys, many = keys[large], -(-counts[large] // SPLIT)
        for batch in batches:
            found = [np.frombuffer(p.as_buffer(), dtype=np.uint64) for p in batch.column("prefix")]
            if found:
                lengths = [len(x) for x in found]
                rid, n = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), lengths) for c in ("rid", "n"))
                flat = np.concatenate(found)
                parts = np.ones(len(flat), dtype=np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                    parts = np.where(keys[at] == flat, many[at], 1)
                place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                marked = 2 * n + (place < early_length(n))
                part = ((rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.where(parts > 1, part + 1, 0).astype(np.int32)), pa.array(rid), pa.array(marked.astype(np.int64))], names=["hash", "part", "rid", "marked"])

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leader, size, own = None, 0, 0, False
        for batch in batches:
            h, p, r, marked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "part", "rid", "marked"))
            n, early = marked >> 1, (marked & 1).astype(bool)
            if not len(h):
                continue
            starts = np.append(True, (h[1:] != h[:-1]) | (p[1:] != p[:-1]))
            starts[0] = last is None or (h[0], p[0]) != last
            first = np.maximum.accumulate(np.where(starts, np.arange(len(h)), -1))
            leaders = np.where(first >= 0, r[np.maximum(first, 0)], leader)
            sizes = np.where(first >= 0, n[np.maximum(first, 0)], size)
            earlies = np.where(first >= 0, early[np.maximum(first, 0)], own)
            run = np.cumsum(starts)
            length = np.bincount(run)[run]
            # A run at either end of a batch may go on in the next one.
            crowd = (length > 2) | (run == run[-1]) | (first < 0) | (p > 0)
            last, leader, size, own = (h[-1], p[-1]), leaders[-1], sizes[-1], earlies[-1]
            more = (r != leaders) | (p > 0)
            near = near_in_size(n, sizes) & can_meet(n, early, sizes, earlies) & (r != leaders)
            yield pa.RecordBatch.from_arrays([pa.array(x[more]) for x in (h, leaders, r, n, early, band(n).astype(np.int32), near, crowd)], names=["hash", "leader", "rid", "n", "early", "band", "near", "crowd"])

    postings = sets.select("rid", "n", "prefix").mapInArrow(emit, "hash bigint, part int, rid bigint, marked bigint")
    sorted_ = postings.repartition("hash", "part").sortWithinPartitions("hash", "part", "rid")
    return stored(sorted_.mapInArrow(lead, "hash bigint, leader bigint, rid bigint, n bigint, early boolean, band int, near boolean, crowd boolean"), "members")


def _small(rows: DataFrame) -> DataFrame:
    """A hint to broadcast ``rows`` where they are few."""
    return F.broadcast(rows) if rows.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else rows


def with_hashes(wanted: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """``wanted`` (rid and more) with the sets' sorted hashes, made anew from texts with those rows' keys. A row may come once from
    each task that holds a copy of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHash(), set()
        for batch in batches:
            rids = batch.column("rid").to_pylist()
            fresh = []
            for i, rid in enumerate(rids):
                if rid not in seen:
                    seen.add(rid)
                    fresh.append(i)
            for piece in pieces(batch.take(pa.array(fresh, pa.int64())), "text", PIECE):
                yield pa.RecordBatch.from_arrays([piece.column("rid"), pa.array([s.tobytes() for s in shingle_sets(piece.column("text"), hasher)], pa.binary())], names=["rid", "hashes"])

    keys = stored(sets.select("rid", "k1", "k2").join(_small(wanted.select("rid").distinct()), "rid"), "keys")
    texts = _keyed(docs).select("k1", "k2", "text").join(_small(keys), ["k1", "k2"]).select("rid", "text")
    return in_batches(texts, run, "rid bigint, hashes binary").join(_small(wanted), "rid")


def _grouped(pairs: DataFrame) -> DataFrame:
    """rid, leader, grp, place of ``pairs`` (leader, rid): place 1, and each leader itself at place 0 of each
    of its groups of about GROUP partners."""
    counts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(float(GROUP))).cast("int").alias("groups"))
    dealt = join_sums(pairs, counts, ["leader"]).select("rid", "leader", F.pmod(F.xxhash64("rid"), F.col("groups")).cast("int").alias("grp"), F.lit(1).alias("place"))
    heads = counts.select(F.col("leader").alias("rid"), "leader", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"), F.lit(0).alias("place"))
    return stored(dealt.unionAll(heads), "wanted")


def _held_against_leaders(rows: DataFrame, data: str, test) -> DataFrame:
    """leader, rid of the rows whose ``data`` and n pass ``test`` with their leader's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, size = np.zeros(0, dtype=np.uint64), 0
        for batch in batches:
            a, b = [], []
            for leader, rid, place, n, raw in zip(*(batch.column(c).to_pylist() for c in ("leader", "rid", "place", "n")), batch.column(data), strict=True):
                own = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                if place == 0:
                    head, size = own.copy(), n
                elif near_in_size(size, n) and test(head, size, own, n):
                    a.append(leader)
                    b.append(rid)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["leader", "rid"])

    ordered = rows.repartition("leader", "grp").sortWithinPartitions("leader", "grp", "place", "rid")
    return ordered.select("leader", "rid", "place", "n", data).mapInArrow(run, "leader bigint, rid bigint")


def bounded(head: np.ndarray, size: int, own: np.ndarray, n: int) -> bool:
    width = min(len(head), len(own))
    unlike = int(np.bitwise_count(fold(head, width) ^ fold(own, width)).sum())
    most = (size + n - unlike) // 2
    return DENOMINATOR * most >= NUMERATOR * (size + n - most)


def let_through(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the ``pairs`` (leader, rid) that sizes and bitmaps let through, stored."""
    grouped = _grouped(pairs)
    signed = sets.select("rid", "n", "bits").join(_small(grouped), "rid")
    out = stored(_held_against_leaders(signed, "bits", bounded).withColumnsRenamed({"leader": "a", "rid": "b"}), "pairs")
    delete_stored(grouped)
    return out


def tiled_pairs(members: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b: edges that, with the blocks so far (``roots``), lead from each set to any other that shares a bucket with it and that size
    and bitmaps let through: a meeting of tiles passes on a forest that spans such pairs of different blocks, not the pairs."""
    # A bucket's first set has been held against the others; of buckets with the same sets one is enough.
    known = _small(roots.withColumnsRenamed({"node": "rid"}))
    placed = members.where("crowd").select("hash", "rid", "n", "early", "band").join(known, "rid", "left").select("hash", "rid", "n", "early", "band", F.coalesce("root", "rid").alias("root"))
    mark = [F.bit_xor(F.xxhash64(F.lit(seed), "rid", "early")).alias(f"x{seed}") for seed in (1, 2)]
    open_ = placed.groupBy("hash").agg(F.count("*").alias("sets"), F.min("root").alias("low"), F.max("root").alias("high"), *mark).where("low < high")
    unlike = stored(open_.groupBy("sets", "x1", "x2").agg(F.min("hash").alias("hash")).select("hash"), "buckets")
    sized = stored(placed.join(_small(unlike), "hash"), "open")
    # A set stays where another block has a set that it can meet: an early one in its own band or the one below, or, for an early set itself,
    # any in its own band or the one above.
    of_early = lambda f: f(F.when(F.col("early"), F.col("root")))
    near = sized.groupBy("hash", "band").agg(F.min("root").alias("low"), F.max("root").alias("high"), of_early(F.min).alias("low_early"), of_early(F.max).alias("high_early"))
    nothing = F.lit(None).cast("bigint")
    reach = F.array(
        F.struct((F.col("band") - 1).alias("band"), F.col("low").alias("low"), F.col("high").alias("high"), nothing.alias("low_early"), nothing.alias("high_early")),
        F.struct("band", "low", "high", "low_early", "high_early"),
        F.struct((F.col("band") + 1).alias("band"), nothing.alias("low"), nothing.alias("high"), F.col("low_early").alias("low_early"), F.col("high_early").alias("high_early")))
    around = near.select("hash", F.explode(reach).alias("s")).select("hash", "s.*")
    mixed = around.groupBy("hash", "band").agg(*[f(c).alias(c) for f, c in ((F.min, "low"), (F.max, "high"), (F.min, "low_early"), (F.max, "high_early"))]).where("low < high OR low_early IS NOT NULL")
    meets = join_sums(sized, mixed, ["hash", "band"]).where("(early AND low < high) OR low_early <> root OR high_early <> root")
    banded = stored(meets.select("hash", "band", "rid", "n", "early", "root"), "banded")
    delete_stored(sized)
    counted = banded.groupBy("hash", "band").agg(F.ceil(F.count("*") / F.lit(float(TILE))).cast("int").alias("tiles"))
    bands = Window.partitionBy("hash").orderBy("band")
    beside = lambda f, step: F.when(f("band").over(bands) == F.col("band") + step, f("tiles").over(bands))
    dealt = join_sums(banded, counted.select("hash", "band", "tiles", beside(F.lead, 1).alias("up"), beside(F.lag, -1).alias("down")), ["hash", "band"])
    dealt = dealt.withColumn("t", F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int"))
    # A tile meets itself, the later tiles of its band, and the tiles of the next band.
    numbers = lambda to: F.sequence(F.lit(0), to - 1)
    own = F.transform(numbers(F.col("tiles")), lambda o: F.struct(F.col("band").alias("low"), F.lit(0).alias("step"), F.least(F.col("t"), o).alias("x"), F.greatest(F.col("t"), o).alias("y"), (F.col("t") > o).cast("int").alias("side")))
    over = F.when(F.col("up").isNotNull(), F.transform(numbers(F.col("up")), lambda o: F.struct(F.col("band").alias("low"), F.lit(1).alias("step"), F.col("t").alias("x"), o.alias("y"), F.lit(0).alias("side"))))
    under = F.when(F.col("down").isNotNull(), F.transform(numbers(F.col("down")), lambda o: F.struct((F.col("band") - 1).alias("low"), F.lit(1).alias("step"), o.alias("x"), F.col("t").alias("y"), F.lit(1).alias("side"))))
    empty = F.array().cast("array<struct<low:int,step:int,x:int,y:int,side:int>>")
    spread = dealt.select("hash", "rid", "root", "n", "early", F.explode(F.concat(own, F.coalesce(over, empty), F.coalesce(under, empty))).alias("p")).select("hash", "rid", "root", "n", "early", "p.*")
    rows = sets.select("rid", "bits").join(_small(stored(spread, "spread")), "rid").repartition("hash", "low", "step", "x", "y").sortWithinPartitions("hash", "low", "step", "x", "y", "side", "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        names = ["hash", "low", "step", "x", "y"]
        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [batch.column(c).to_pylist() for c in (*names, "side", "rid", "root", "n", "bits", "early")]
            for row in zip(*columns, strict=True):
                if row[:5] != key:
                    out += tile_forest(key, held)
                    key, held = row[:5], []
                held.append(row[5:])
            yield _pairs(out)
        yield _pairs(tile_forest(key, held))

    return rows.select("hash", "low", "step", "x", "y", "side", "rid", "root", "n", "bits", "early").mapInArrow(run, "a bigint, b bigint")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])


class Forest:
    """Disjoint sets of the places 0..n-1, some united from the start."""

    def __init__(self, groups: list):
        first: dict = {}
        self.parent = [first.setdefault(g, i) for i, g in enumerate(groups)]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def unite(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def tile_forest(key: tuple | None, held: list[tuple]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs let through inside one meeting of tiles: side, rid, root, n, bits, early of each set."""
    if key is None or len(held) < 2:
        return []
    same = key[2] == 0 and key[3] == key[4]
    first = held if same else [h for h in held if h[0] == 0]
    second = held if same else [h for h in held if h[0] == 1]
    if not first or not second:
        return []
    width = min(len(h[4]) for h in held) // 8
    maps, to_maps = (np.stack([fold(np.frombuffer(h[4], dtype=np.uint64), width) for h in x]) for x in (first, second))
    (r, c, n), (s, d, m) = ([np.array([h[k] for h in x], dtype=np.int64) for k in (1, 2, 3)] for x in (first, second))
    early, others = (np.array([h[5] for h in x], dtype=bool) for x in (first, second))
    place = {rid: i for i, rid in enumerate(dict.fromkeys([*r.tolist(), *s.tolist()]))}
    forest, out = Forest(list(place)), []
    at, to = (np.array([place[x] for x in y.tolist()]) for y in (r, s))
    group = np.arange(len(place))
    step = max(1, (1 << 21) // (len(second) * width))
    for a in range(0, len(first), step):
        ok = could_be_similar(n[a : a + step], maps[a : a + step], m, to_maps) & can_meet(n[a : a + step, None], early[a : a + step, None], m[None, :], others[None, :]) & (c[a : a + step, None] != d[None, :])
        for i in range(len(ok)):
            # Of the partners, those that were not yet in one tree with this set when last looked at.
            for j in np.flatnonzero(ok[i] & (group[to] != group[at[a + i]])).tolist():
                if forest.unite(int(at[a + i]), int(to[j])):
                    out.append((int(r[a + i]), int(s[j])))
                group[to[j]] = group[at[a + i]] = forest.find(int(to[j]))
    return out


def block_links(blocks: DataFrame, classes: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b, links, copies, stored. Where a = b: how many sets it is linked to in one meeting of tiles, and how many rows those have; else a
    link of a forest that spans the links. Blocks (node, root) too large for one task are cut into tiles that meet in pairs, each pair in its own task."""
    inside = blocks.select(F.col("node").alias("rid"), F.col("root").alias("block")).unionAll(blocks.select(F.col("root").alias("rid"), F.col("root").alias("block")).distinct())
    sized = stored(classes.select(F.col("cid").alias("rid"), "n", "copies").join(_small(stored(inside, "inside")), "rid"), "blocks")
    tiles = sized.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / F.lit(float(BLOCK_SETS))), F.ceil(F.sum("n") / F.lit(float(BLOCK_SHINGLES)))).cast("int").alias("tiles"))
    dealt = join_sums(sized, tiles, ["block"]).withColumn("t", F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(F.col("t"), o).alias("x"), F.greatest(F.col("t"), o).alias("y"), (F.col("t") > o).cast("int").alias("side")))
    wanted = stored(dealt.select("rid", "block", "copies", F.explode(meets).alias("p")).select("rid", "block", "copies", "p.*"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("block", "x", "y", "side", "rid", "copies", "hashes")], strict=True):
                if row[:3] != key:
                    yield meeting_links(key, held)
                    key, held = row[:3], []
                if not held or held[-1][1] != row[4]:  # a row comes once from each task that holds its text
                    held.append(row[3:])
        yield meeting_links(key, held)

    rows = with_hashes(wanted, sets, docs).repartition("block", "x", "y").sortWithinPartitions("block", "x", "y", "side", "rid")
    return stored(rows.select("block", "x", "y", "side", "rid", "copies", "hashes").mapInArrow(run, "a bigint, b bigint, links bigint, copies bigint"), "links")


def meeting_links(key: tuple | None, held: list[tuple]) -> pa.RecordBatch:
    """The rows of ``block_links`` for one meeting: side, rid, copies, hashes of each set."""
    out: list[tuple[int, int, int, int]] = []
    if key is not None and len(held) > 1:
        arrays = [np.frombuffer(h[3], dtype=np.uint64) for h in held]
        order = np.argsort(np.array([len(x) for x in arrays]), kind="stable")
        arrays = [arrays[i] for i in order]
        sides, rids, copies = (np.array([h[k] for h in held], dtype=np.int64)[order] for k in range(3))
        sizes = np.array([len(x) for x in arrays], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        width = min(MOST_BITS, 64 << max(0, (8 * int(sizes.max()) - 1).bit_length() - 6)) // 64
        maps = np.stack([bitmap(x, width * 64) for x in arrays])
        # Shingles as numbers from 0, so that an overlap is a count of marks.
        distinct, flat = np.unique(np.concatenate(arrays), return_inverse=True)
        marks = np.zeros(len(distinct), dtype=bool)
        forest, within = Forest(list(range(len(held)))), key[1] == key[2]
        links, linked = np.zeros(len(held), dtype=np.int64), np.zeros(len(held), dtype=np.int64)
        lasts = np.searchsorted(sizes, DENOMINATOR * sizes // NUMERATOR, side="right")
        for i in range(len(held)):
            # Only larger sets of near size, further on in the order.
            rest = np.arange(i + 1, max(i + 1, int(lasts[i])))
            if not within:
                rest = rest[sides[rest] != sides[i]]
            if not len(rest):
                continue
            rest = rest[could_be_similar(sizes[i : i + 1], maps[i : i + 1], sizes[rest], maps[rest])[0]]
            mine = flat[begins[i] : begins[i] + sizes[i]]
            marks[mine] = True
            step = max(1, (1 << 21) // int(sizes[rest].max())) if len(rest) else 1
            for a in range(0, len(rest), step):
                some = rest[a : a + step]
                common = np.add.reduceat(marks[flat[ragged(begins[some], sizes[some])]], np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
                like = some[DENOMINATOR * common >= NUMERATOR * (sizes[i] + sizes[some] - common)]
                links[i] += len(like)
                linked[i] += copies[like].sum()
                links[like] += 1
                linked[like] += copies[i]
                out += [(int(rids[i]), int(rids[j]), 0, 0) for j in like.tolist() if forest.unite(i, j)]
            marks[mine] = False
        out += [(r, r, n, m) for r, n, m in zip(rids.tolist(), links.tolist(), linked.tolist(), strict=True) if n]
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links", "copies"])


def classify(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, k1, k2, n, digest of the rows of ``docs`` (doc_id, text), and for each digest: cid, root (of its component), component_id, links,
    linked_rows. Tables are deleted as soon as they are of no more use."""
    spark = docs.sparkSession
    rows, counts = scan(docs)
    hot = spark.sparkContext.broadcast(hot_shingles(counts))
    sets = first_sets(docs, hot)
    of_digest = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = stored(of_digest.join(sets.select("digest", F.col("rid").alias("cid"), "n"), "digest"), "classes")
    free_shuffles(spark)
    members = bucket_members(sets, hot)
    free_shuffles(spark)
    near = stored(members.where("near").select("leader", "rid").distinct(), "near")
    met = let_through(near, sets)
    roots = components(met)
    tiled = stored(tiled_pairs(members, sets, roots), "tiled")
    blocks = components(met.unionAll(tiled))
    for table_ in (near, members, met, tiled, roots):
        delete_stored(table_)
    free_shuffles(spark)
    links = block_links(blocks, classes, sets, docs)
    delete_stored(blocks)
    final = components(links.select("a", "b"))
    placed = classes.join(final.withColumnsRenamed({"node": "cid"}), "cid", "left").select("digest", "least", "cid", "copies", F.coalesce("root", "cid").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    degrees = links.where("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"), F.sum("copies").alias("linked"))
    found = join_sums(placed, lowest, ["root"]).join(degrees, "cid", "left").select(
        "digest", "cid", "root", "component_id", F.coalesce("links", F.lit(0)).alias("links"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("linked_rows"))
    out = stored(found, "of_class")
    for table_ in (classes, final, links, sets):
        delete_stored(table_)
    free_shuffles(spark)
    return rows, out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, links, linked_rows, class_id (a digest of the set) for each row of ``docs`` (doc_id, text).

    component_id: least doc_id reachable by links (null if none of them has a doc_id). links: other sets that its own is similar
    to; linked_rows: other rows with such a set or its own. Null and empty texts have no shingles, class null, no links and
    their own doc_id as component. Repeated rows are in one class and returned each.
    """
    sets, of_class = classify(docs)
    out = sets.select("doc_id", "n", "digest").join(of_class.select("digest", "component_id", "links", "linked_rows"), "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("linked_rows", F.lit(0)).alias("linked_rows"), F.lower(F.hex("digest")).alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the least doc_id (nulls last, then by text key);
    of equal rows one stays. Rows without shingles all stay."""
    sets, of_class = classify(docs)
    rows = sets.where("digest IS NOT NULL").join(of_class.select("digest", "root"), "digest").select("root", F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    name = F.struct("none", "doc_id", "k1", "k2").alias("name")
    counted = stored(rows.groupBy("root", name).agg(F.count("*").alias("n")), "names")
    best = counted.groupBy("root").agg(F.min("name").alias("best"))
    judged = join_sums(counted, best, ["root"]).withColumn("stays", F.col("name") == F.col("best"))
    # Every other row of a group goes; of rows that share the best name, one is taken.
    marked = stored(judged.where("NOT stays OR n > 1").select(F.col("name.k1").alias("__k1"), F.col("name.k2").alias("__k2"), F.coalesce(F.col("name.doc_id").cast("string"), F.lit("null")).alias("__id"), F.col("stays").alias("__stays")), "marked")
    key = ["__k1", "__k2", "__id"]
    names = [f"__c{i}" for i in range(len(docs.columns))]
    lower = [c.lower() for c in docs.columns]
    text, doc_id = (names[docs.columns.index(c) if c in docs.columns else lower.index(c)] for c in ("text", "doc_id"))
    keyed = docs.toDF(*names).select("*", F.xxhash64(text).alias("__k1"), F.xxhash64(F.lit("second"), text).alias("__k2"), F.coalesce(F.col(doc_id).cast("bigint").cast("string"), F.lit("null")).alias("__id"))
    alone = keyed.join(_small(marked.select(*key)), key, "left_anti").select(*names)
    one = keyed.join(_small(marked.where("__stays").select(*key)), key, "left_semi").dropDuplicates(key).select(*names)
    return alone.unionAll(one).toDF(*docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
