"""Pairs of like sets: blocks of sets meet as matrices, so no pair is written, shuffled or looked at again but those that are alike.

Sets of bigrams have few elements in common use, so nearly every two sets share some: an inverted index of them would hold nearly all pairs. Here
rows are packed into blocks; every block of one side goes to the tasks that hold blocks of the other (in groups of checked size), and a product of two
blocks counts what all their pairs share. What is kept is bounded by what is returned; the products themselves are as many as pairs of blocks.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.shared import in_batches, stored

#: Sets of a block, and sets of the left side that are sent to the tasks at once.
BLOCK, GROUP = 2048, 16_384
#: Blocks of the right side that a task gets, and elements of one product. An element that fewer than one in so many pairs of a product share is counted pair by pair.
TASK_BLOCKS, PRODUCT, RARE = 2, 1024, 1000
SCALE = 1_000_000


def element_codes(grams: Column) -> Column:
    """A number for each of strings of one or two characters, another for each string."""
    return F.transform(grams, lambda g: F.ascii(g).cast("bigint") * (1 << 22) + F.when(F.length(g) > 1, F.ascii(F.substring(g, 2, 1)) + 1).otherwise(0))


def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` (id, kind, codes, version) as stored blocks of up to ``block`` sets of one kind each: block (a number drawn for it), kind, n, ids, versions, sizes, codes."""
    ordered = rows.select("id", "kind", "codes", F.col("version").cast("bigint").alias("version")).sortWithinPartitions("kind")
    schema = "block bigint, kind string, n int, ids array<string>, versions array<bigint>, sizes binary, codes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}

        def whole(kind):
            ids, versions, codes = zip(*held.pop(kind), strict=True)
            sizes = np.array([len(c) for c in codes], dtype=np.int32)
            packed = [pa.compress(a.tobytes(), codec="zstd", asbytes=True) for a in (sizes, np.concatenate(codes))]
            values = [[secrets.randbits(62)], [kind], [len(ids)], [ids], [versions], *[[p] for p in packed]]
            types = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["block", "kind", "n", "ids", "versions", "sizes", "codes"])

        for batch in batches:
            flat = batch.column("codes")
            at = flat.offsets.to_numpy() - flat.offsets[0].as_py()
            numbers = flat.flatten().to_numpy(zero_copy_only=False)
            for k, (i, kind, version) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "kind", "version")), strict=True)):
                held.setdefault(kind, []).append((i, version, numbers[at[k] : at[k + 1]].copy()))
                if len(held[kind]) == block:
                    yield whole(kind)
        for kind in list(held):
            yield whole(kind)

    return stored(in_batches(ordered, run, schema), "sets")


def _unpacked(n: int, sizes: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.frombuffer(pa.decompress(sizes, decompressed_size=4 * n, codec="zstd", asbytes=True), dtype=np.int32)
    total = int(sizes.sum())
    return sizes.astype(np.int64), np.frombuffer(pa.decompress(codes, decompressed_size=8 * total, codec="zstd", asbytes=True), dtype=np.int64)


def shared_counts(a_sizes: np.ndarray, a_codes: np.ndarray, b_sizes: np.ndarray, b_codes: np.ndarray) -> np.ndarray:
    """How many elements each set of one block shares with each of the other."""
    out = np.zeros((len(a_sizes), len(b_sizes)), dtype=np.float32)
    common = np.intersect1d(a_codes, b_codes)

    def places(sizes, codes):
        at = np.searchsorted(common, codes)
        good = at < len(common)
        good[good] = common[at[good]] == codes[good]
        return np.repeat(np.arange(len(sizes)), sizes)[good], at[good]

    (a_row, a_at), (b_row, b_at) = places(a_sizes, a_codes), places(b_sizes, b_codes)
    a_many, b_many = np.bincount(a_at, minlength=len(common)), np.bincount(b_at, minlength=len(common))
    often = a_many * b_many * RARE >= out.size
    column = np.cumsum(often) - 1
    for first in range(0, int(often.sum()), PRODUCT):
        width = min(PRODUCT, int(often.sum()) - first)

        def dense(rows, at, n, first=first, width=width):
            keep = often[at] & (column[at] >= first) & (column[at] < first + width)
            m = np.zeros((n, width), dtype=np.float32)
            m[rows[keep], column[at[keep]] - first] = 1
            return m

        out += dense(a_row, a_at, len(a_sizes)) @ dense(b_row, b_at, len(b_sizes)).T
    seldom = np.flatnonzero(~often)
    if len(seldom):
        a_order, b_order = np.argsort(a_at, kind="stable"), np.argsort(b_at, kind="stable")
        a_end, b_end = np.cumsum(a_many), np.cumsum(b_many)
        for g in seldom:
            out[np.ix_(a_row[a_order[a_end[g] - a_many[g] : a_end[g]]], b_row[b_order[b_end[g] - b_many[g] : b_end[g]]])] += 1
    return out


def _best(left: np.ndarray, score: np.ndarray, version: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k`` rows of each left set: by score, then version, both descending, then right id."""
    rank = np.unique(right, return_inverse=True)[1]
    order = np.lexsort((rank, -version, -score, left))
    place = np.arange(len(order))
    starts = np.flatnonzero(np.diff(left[order], prepend=-1))
    return order[place - np.repeat(starts, np.diff(np.append(starts, len(order)))) < k]


def _meet(least: float, most: int | None):
    types = [pa.string(), pa.string(), pa.float64(), pa.int64()]
    names = ["left_id", "right_id", "similarity", "version"]
    floor = round(least * SCALE)

    def rows(left, right, score, version) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((left, right, score / SCALE, version), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        ids: dict[int, list[str]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                (a_sizes, a_codes), (b_sizes, b_codes) = _unpacked(r["a_n"], r["a_sizes"], r["a_codes"]), _unpacked(r["n"], r["sizes"], r["codes"])
                both = a_sizes[:, None] + b_sizes[None, :]
                shared = shared_counts(a_sizes, a_codes, b_sizes, b_codes)
                i, j = np.nonzero(2 * shared >= (least - 1 / SCALE) * both)
                # Six places, halves up, in whole numbers.
                score = (4 * SCALE * shared[i, j].astype(np.int64) + both[i, j]) // (2 * both[i, j])
                i, j, score = i[score >= floor], j[score >= floor], score[score >= floor]
                right, version = np.array(r["ids"], dtype=object)[j], np.array([v or 0 for v in r["versions"]], dtype=np.int64)[j]
                if most is None:
                    yield rows(np.array(r["a_ids"], dtype=object)[i], right, score, version)
                    continue
                ids[r["a_block"]] = r["a_ids"]
                old = held.get(r["a_block"])
                found = [np.concatenate(x) for x in zip(old, (i, score, version, right), strict=True)] if old else [i, score, version, right]
                cut = _best(found[0], found[1], found[2], found[3], most)
                held[r["a_block"]] = [x[cut] for x in found]
        for block, (i, score, version, right) in held.items():
            yield rows(np.array(ids[block], dtype=object)[i], right, score, version)

    return run


def alike(left: DataFrame, right: DataFrame, least: float, most: int | None = None) -> DataFrame:
    """left_id, right_id, similarity, version of pairs of one kind whose Dice similarity, to six places, is ``least`` or more. ``left`` and ``right``: id, kind,
    codes (each once, one at least), version. With ``most`` at least that many of the best of each left set are among the rows, by similarity, then version, then right_id."""
    a, b = blocks(left), blocks(right)
    asked = [(r.block, r.n) for r in a.select("block", "n").collect()]  # one row for BLOCK sets
    groups, size = [[]], 0
    for block, n in asked:
        if groups[-1] and size + n > GROUP:
            groups.append([])
            size = 0
        groups[-1].append(block)
        size += n
    tasks = max(1, -(-b.count() // TASK_BLOCKS))
    schema = "left_id string, right_id string, similarity double, version bigint"
    parts = None
    for group in groups:
        mine = a.where(F.col("block").isin(group)).select("kind", F.col("block").alias("a_block"), F.col("n").alias("a_n"), F.col("ids").alias("a_ids"), F.col("sizes").alias("a_sizes"), F.col("codes").alias("a_codes"))
        met = in_batches(b.drop("block").repartition(tasks).join(F.broadcast(mine), "kind"), _meet(least, most), schema)
        if len(groups) > 1:
            met = stored(met, "alike")
        parts = met if parts is None else parts.unionAll(met)
    return parts
