"""Shared helpers: shared folders, text batches as Arrow arrays, word splitting."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step in Python holds at once.
PIECE_BYTES = 6 << 20
#: Bytes of one Arrow batch on its way to Python: the JVM holds a batch twice outside of its heap, a worker once.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is set on a local master; on a cluster, whose machines
    do not share one, ValueError.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="memloom-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/memloom/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage for good."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def delete_stored(df: DataFrame) -> None:
    """Delete a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that are out of use: Spark drops them once the driver has collected its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def join_sums(rows: DataFrame, sums: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with columns of ``sums``, an aggregate by ``key``. A mark beside the key has both sides dealt anew, next to the join,
    where adaptive execution can split a key that holds many rows; an aggregate's own partitions would be joined as they are."""
    marked = lambda df: df.withColumn("__mark", F.xxhash64(F.lit("mark"), *key))
    return marked(rows).join(marked(sums), [*key, "__mark"], how).drop("__mark")


#: What this worker keeps from one task for the next, by name.
_HELD: dict[str, object] = {}


def held(name: str, build: Callable[[], object]):
    """What ``build`` gives, kept in this worker under ``name`` until a task comes that does not use it."""
    if name not in _HELD:
        _HELD[name] = build()
    return _HELD[name]


def let_go(uses: tuple[str, ...] = ()) -> None:
    """Drop what this worker holds for other kinds of tasks: workers live on from stage to stage."""
    if others := [n for n in _HELD if n not in uses]:
        for n in others:
            del _HELD[n]
        gc.collect()
        release()


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, uses: tuple[str, ...] = ()) -> DataFrame:
    """``df.mapInArrow``, its batches bounded by bytes: long texts would make them large. ``uses``: names of what
    ``run`` takes from ``held``; all else that a worker holds is let go of before."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(uses)
        yield from run(batches)

    return df.mapInArrow(alone, schema)


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo; null for null."""
    return (F.crc32(column.cast("string").cast("binary")) % modulus).cast("int")


def plain(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one string array without nulls (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):  # more than 2 GB stay in chunks
        texts = pa.concat_arrays(texts.cast(pa.large_string()).chunks)
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.cast(pa.string())
    return pc.fill_null(texts, "")


def release() -> None:
    """Give freed memory back to the system: a worker is used again by later stages, and would keep its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class WordHash:
    """Two 64-bit hashes of each string of an array, the halves of a blake2b digest: no two strings can be made that share them."""

    def __call__(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = strings.cast(pa.large_binary() if pa.types.is_large_string(strings.type) else pa.binary()).to_pylist()
        digest = hashlib.blake2b
        pairs = np.frombuffer(b"".join([digest(w, digest_size=16).digest() for w in raw]), dtype="<u8").reshape(-1, 2)
        return pairs[:, 0].copy(), pairs[:, 1].copy()


def word_names(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that name each string: the bytes of one of up to 15 with their number, else all but a byte of a blake2b digest."""
    wide = pa.types.is_large_string(strings.type)
    ends = np.frombuffer(strings.buffers()[1], dtype=np.int64 if wide else np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64) if len(strings) else np.zeros(1, np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", dtype=np.uint8) if len(strings) else np.zeros(0, np.uint8)
    sizes = np.diff(ends)
    named = np.zeros((len(sizes), 16), dtype=np.uint8)
    short = np.flatnonzero(sizes <= 15)
    lengths = sizes[short]
    named.reshape(-1)[ragged(short * 16, lengths)] = data[ragged(ends[short], lengths)]
    named[:, 15] = np.minimum(sizes, 255)
    for i in np.flatnonzero(sizes > 15).tolist():
        named[i, :15] = np.frombuffer(hashlib.blake2b(data[ends[i] : ends[i + 1]], digest_size=15).digest(), dtype=np.uint8)
        named[i, 15] = 255
    pairs = named.view("<u8")
    return pairs[:, 0], pairs[:, 1]


def mixed(first: np.ndarray, second: np.ndarray, seeds: tuple[int, int] = (0, 0)) -> np.ndarray:
    """One 64-bit hash of each pair of numbers. Who doesn't know the ``seeds`` can't make two pairs that share one."""

    def stir(x: np.ndarray) -> np.ndarray:
        x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ x >> np.uint64(33)

    return stir(stir(first ^ np.uint64(seeds[0])) ^ second ^ np.uint64(seeds[1]))


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``most`` bytes of text each, or one row."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < n:
        floor = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, floor + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    release()


def offsets_of(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.offsets.to_numpy(zero_copy_only=False), dtype=np.int64)


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: codes, row offsets, distinct words.

    ``lower`` lower-cases A-Z alone. Words of row i are ``codes[offsets[i]:offsets[i + 1]]``.
    """
    texts = plain(texts)
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = offsets_of(lists)
    flat = lists.values[offsets[0] : offsets[-1]] if len(offsets) else lists.values
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    return codes, offsets, encoded.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``starts[i] .. starts[i] + lengths[i]``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` for each row of ``offsets``."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]
