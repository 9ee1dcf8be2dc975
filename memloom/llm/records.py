"""Token ids as length-delimited binary records with masked checksums and an offset index.

A record is: length (8 bytes, little-endian) | masked crc32 of those 8 bytes (4) | payload |
masked crc32 of the payload (4) | line feed. A payload is: flags (1: bit 0 key is null,
bit 1 ids have 4 bytes) | key (8, signed) | ids, 2 or 4 bytes each, little-endian.
Masking rotates a checksum right by 15 bits and adds a constant, so that checksums of
data that hold checksums stay strong.

Spark's text writer puts out each row's bytes unchanged and then a line feed, so
records go through Spark's commit protocol to any file system it can write: a lost task is
written anew and never seen twice. One file holds one range of the order key.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.subwords import HELD, WordEncoder, default_path, encoder
from memloom.llm.textio import in_batches, let_go, pieces, plain, release, shared_path, table

# Fixed values of the masking used by length-delimited record files.
MASK_ROTATE, MASK_ADD = 15, 0xA282EAD8
HEAD, KEY, TAIL = struct.Struct("<QI"), struct.Struct("<Bq"), struct.Struct("<I")
END_ID = 2
#: Text characters for one file; a file is read back whole by one task.
SHARD_CHARS = 16 << 20
#: Text bytes encoded at once.
ENCODE_BYTES = 2 << 20
#: Files are cut by a sample of so many rows each, of no more rows in all, and there are no more files: beyond that
#: (3 TB of text) files grow, and neither the driver nor a broadcast holds more than these.
SAMPLES_A_FILE, SAMPLE_ROWS, MOST_FILES = 200, 1_000_000, 200_000
PLACE = np.dtype([("some", "?"), ("key", "<i8"), ("hash", "<i8")])


def masked_crc(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return (((crc >> MASK_ROTATE) | (crc << (32 - MASK_ROTATE))) + MASK_ADD) & 0xFFFFFFFF


def frame(key: int | None, ids: np.ndarray, wide: bool) -> bytes:
    payload = KEY.pack((key is None) | wide << 1, key or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked_crc(length)) + payload + TAIL.pack(masked_crc(payload))


def read_frame(data: bytes | memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """Key, ids and the place after the record; ValueError where bytes are damaged."""
    if at + HEAD.size > len(data):
        raise ValueError(f"record cut short at byte {at}")
    length, crc = HEAD.unpack_from(data, at)
    if masked_crc(data[at : at + 8]) != crc:
        raise ValueError(f"damaged length at byte {at}")
    start, end = at + HEAD.size, at + HEAD.size + length
    if end + 5 > len(data) or data[end + 4] != 10:
        raise ValueError(f"record cut short at byte {at}")
    payload = data[start:end]
    if masked_crc(payload) != TAIL.unpack_from(data, end)[0]:
        raise ValueError(f"damaged record at byte {at}")
    flags, key = KEY.unpack_from(payload)
    return None if flags & 1 else key, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=KEY.size), end + 5


def _bounds(keyed: DataFrame, most_chars: int) -> np.ndarray:
    """Ordered (key, hash) bounds that cut the rows into ranges of about equal text, at most MOST_FILES ranges.

    They are quantiles of a hash-drawn sample of SAMPLE_ROWS rows or fewer, whatever the size of the table."""
    total, n = keyed.agg(F.sum("chars"), F.count("*")).first()
    files = min(MOST_FILES, max(1, -(-int(total or 0) // most_chars)))
    if files == 1 or not n:
        return np.zeros(0, dtype=PLACE)
    every = max(1, n // min(SAMPLE_ROWS, SAMPLES_A_FILE * files))
    sample = keyed.where(F.pmod(F.xxhash64("key", "hash"), F.lit(every)) == 0).select("key", "hash", "chars").toArrow()
    at = _places(sample.column("key"), sample.column("hash"))
    order = np.argsort(at, order=("some", "key", "hash"))
    sums = np.cumsum(sample.column("chars").to_numpy()[order] + 1)
    if not len(sums):
        return np.zeros(0, dtype=PLACE)
    cuts = np.searchsorted(sums, sums[-1] * np.arange(1, files) / files)
    return np.unique(at[order][cuts])


def _places(keys: pa.Array | pa.ChunkedArray, hashes: pa.Array | pa.ChunkedArray) -> np.ndarray:
    at = np.zeros(len(keys), dtype=PLACE)
    at["some"] = np.asarray(keys.is_valid())
    at["key"] = keys.fill_null(0).to_numpy()
    at["hash"] = hashes.to_numpy()
    return at


def _framed(piece: pa.RecordBatch, coder: WordEncoder, end_id: int, wide: bool) -> pa.Array:
    ids, ends = coder.encode(plain(piece.column("text")))
    owners = piece.column("doc_id").to_pylist()
    return pa.array([frame(owners[i], np.append(ids[ends[i] : ends[i + 1]], end_id), wide) for i in range(piece.num_rows)], pa.binary())


def write_records(docs: DataFrame, path: str, order: Column | None = None, tokenizer: str | None = None,
                  end_id: int = END_ID, shard_chars: int = SHARD_CHARS, as_stored: bool = False) -> None:
    """Encode ``docs`` (doc_id, text) and write one record a row, in ascending ``order``.

    ``order``: a bigint, doc_id by default; nulls come first, ties by text hash and bytes. ``as_stored``: in the order
    in which the rows lie, a file for each part of the input, without a shuffle; for rows that are in their order already.
    Null and empty texts become the end id alone; repeated rows are written each time;
    an empty table writes files without records.
    """
    tokenizer = tokenizer or default_path()
    doc_id, text = F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        wide = max(coder.vocabulary, end_id) > 1 << 16
        for batch in batches:
            for piece in pieces(batch, "text", ENCODE_BYTES):
                yield pa.RecordBatch.from_arrays([_framed(piece, coder, end_id, wide)], names=["frame"])

    if as_stored:
        ordered = in_batches(docs.select(doc_id, text), encode, "frame binary", (HELD,))
    else:
        key = (F.col("doc_id") if order is None else order).cast("bigint")
        rows = docs.select(key.alias("key"), doc_id, F.xxhash64("text").alias("hash"), text)
        bounds = _bounds(rows.select("key", "hash", F.coalesce(F.length("text"), F.lit(0)).alias("chars")), shard_chars)
        shared = docs.sparkSession.sparkContext.broadcast(bounds)

        def encode_keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder, cuts = encoder(tokenizer), shared.value
            wide = max(coder.vocabulary, end_id) > 1 << 16
            for batch in batches:
                for piece in pieces(batch, "text", ENCODE_BYTES):
                    keys, hashes = piece.column("key"), piece.column("hash")
                    shard = np.searchsorted(cuts, _places(keys, hashes)) if len(cuts) else np.zeros(piece.num_rows)
                    yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), keys, hashes, _framed(piece, coder, end_id, wide)], names=["shard", "key", "hash", "frame"])

        framed = in_batches(rows, encode_keyed, "shard int, key bigint, hash bigint, frame binary", (HELD,))
        ordered = framed.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(F.col("key").asc_nulls_first(), "hash", "frame")
    ordered.select(F.col("frame").cast("string").alias("value")).write.option("compression", "none").text(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Scan all files of ``path`` once, verify every checksum and index each record.

    shard, record (place within the shard), offset, size in bytes, doc_id, n_tokens,
    ids_crc32 (crc32 of the ids as 4 bytes each), before (ids before it in its shard).
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for file, content in zip(batch.column("file"), batch.column("content"), strict=True):
                data, at, rows, before = memoryview(content.as_buffer()), 0, [], 0
                shard = int(file.as_py().rsplit("part-", 1)[1].split("-")[0])
                while at < len(data):
                    doc_id, ids, after = read_frame(data, at)
                    rows.append((shard, len(rows), at, after - at, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), before))
                    before, at = before + len(ids), after
                columns = list(zip(*rows, strict=True)) or [[]] * 8
                del data
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, INDEX_TYPES, strict=True)], names=INDEX_NAMES)
            release()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.col("path").alias("file"), "content").mapInArrow(scan, INDEX_SCHEMA)


INDEX_NAMES = ["shard", "record", "offset", "size", "doc_id", "n_tokens", "ids_crc32", "before"]
INDEX_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
INDEX_SCHEMA = "shard int, record bigint, offset bigint, size bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint, before bigint"


def indexed(spark: SparkSession, path: str) -> DataFrame:
    """The offset index of ``path``, written beside it as Parquet and read back, with
    ``start``: ids of all records before it. One number a file, of MOST_FILES files at most unless
    rows were written as stored, goes to the driver and is joined to the index."""
    index = f"{path}.index"
    read_index(spark, path).write.parquet(index)
    rows = spark.read.schema(INDEX_SCHEMA).parquet(index)
    totals = sorted(rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    starts, seen = [], 0
    for r in totals:
        starts.append((r.shard, seen))
        seen += r.n
    first = spark.createDataFrame(starts, "shard int, first bigint")
    return rows.join(F.broadcast(first) if len(starts) <= MOST_FILES else first, "shard").withColumn("start", F.col("first") + F.col("before")).drop("first")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Ids of the index rows ``wanted``, in any order, by seeking to their offsets: doc_id, ids.

    The rows of one file meet in one task, which takes their bytes out of the file.
    """
    places = wanted.groupBy("shard").agg(F.collect_list(F.struct("offset", "size")).alias("places"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    shard = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, spots in zip(batch.column("content"), batch.column("places").to_pylist(), strict=True):
                data = content.as_py()
                found = [read_frame(data, s["offset"]) for s in spots]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1].tolist() for f in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return files.select(shard.alias("shard"), "content").join(places, "shard").select("content", "places").mapInArrow(seek, "doc_id bigint, ids array<bigint>")


def token_records(docs: DataFrame, order: Column | None = None, tokenizer: str | None = None, path: str | None = None, as_stored: bool = False) -> DataFrame:
    """Write ``docs`` as records and return what is read back: doc_id, start, n_tokens, ids_crc32, shard, offset, size."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "records")
    write_records(docs, path, order, tokenizer, as_stored=as_stored)
    return indexed(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "size")


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"))
