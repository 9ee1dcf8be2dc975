"""Language-model scores of whole texts: a word unigram base and a self-attention model.

The base needs the count of every word in the training documents, wherever it occurs.
Texts are worked on in chunks. A chunk sends its distinct words' hashes and counts, packed by hash
range, to where that range of all chunks is summed, and gets back the sums for its words. So
no vocabulary is ever in one place; a range is bounded, and the number of ranges grows with the words.

Subwords are encoded once and stored with the chunks. How often each occurs, and beside which of the commonest ones,
is counted over all training texts; the attention model's classes and shares come from those counts. Its weights are
trained on every window of all training texts: in each of a few rounds every task goes on from the same weights over a part of its
windows, and the changes are averaged. Windows that score overlap, and score each subword once.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.attention import MARKS, WIDTH, Adam, AttentionModel, TrainingWindows, neighbours, token_classes
from memloom.llm.subwords import HELD, default_path, encoder
from memloom.llm.textio import crc_mod, in_batches, mixed, pieces, plain, release, row_sums, stored, table, word_names, words

#: Training goes over all texts, and again over few of them, until it has gone over so many characters at least. One task takes about as many.
LEAST_CHARS = 16_000_000
#: Times that the tasks' weights are averaged, windows of one step, and the first step's rate.
ROUNDS, BATCH, RATE = 8, 64, 0.01
#: Rows of the embedding whose changes are averaged at once.
ROWS = 1 << 13
#: Text bytes of one chunk, and distinct words (each once a chunk) of one hash range.
CHUNK_BYTES, RANGE_WORDS = 4 << 20, 1 << 20
#: Counts that one task sums at once.
PART = 1 << 19


def train(documents: DataFrame, tokenizer: str | None = None, sample_chars: int = LEAST_CHARS) -> AttentionModel:
    """The model of ``documents`` (text): all of them, gone over until ``sample_chars`` characters at least have been met."""
    rows = documents.where("text IS NOT NULL").select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(True).alias("trains"), F.lit(False).alias("held"))
    return train_on(make_chunks(rows, tokenizer), tokenizer, sample_chars)


def train_on(chunks: DataFrame, tokenizer: str | None = None, sample_chars: int = LEAST_CHARS) -> AttentionModel:
    """The model of all training texts of ``chunks``, gone over until ``sample_chars`` characters at least have been met."""
    end = encoder(tokenizer or default_path()).vocabulary
    counts = dense_sums(chunks, end, end + 1, lambda total, flat: np.add(total, np.bincount(flat[1:], minlength=len(total)), out=total, casting="unsafe"))
    met = counts.copy()
    met[end] = 0
    common = np.argsort(-met, kind="stable")[: int((met > 0).sum())]
    beside = dense_sums(chunks, end, len(common) * 2 * MARKS, neighbours(common, end + 1)).reshape(len(common), 2 * MARKS)
    classes = token_classes(met, common, beside)
    del beside
    total = chunks.agg(F.coalesce(F.sum("n_chars"), F.lit(0))).first()[0] + 100 * int(counts[end])  # a short text is a window as well
    passes = max(1, -(-sample_chars // max(total, 1)))
    parts = max(1, round(total / LEAST_CHARS))

    def fit(model: AttentionModel) -> None:
        for number in range(ROUNDS if total else 0):
            fit_round(chunks.coalesce(parts), model, number, passes)

    return AttentionModel([], end, statistics=(counts, classes), fit=fit)


def fit_round(chunks: DataFrame, model: AttentionModel, number: int, passes: int) -> None:
    """One of ROUNDS rounds, which together go ``passes`` times over every window of the training texts. Each task steps over its share from
    the same weights; their changes are averaged, by the steps of a task, or for a row of the embedding by those that met it."""
    end, shared = model.end, chunks.sparkSession.sparkContext.broadcast(model)
    rate, names, kind = RATE * (1 - number / ROUNDS) + 1e-4, [k for k in model.p if k != "e"], "part int, task int, rows binary, met binary, moved binary"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, old = TaskContext.get().partitionId(), shared.value
        mine = old.fresh()
        adam = Adam(mine.p)

        def steps(windows: tuple, least: int) -> tuple:
            a = 0
            while len(windows[0]) - a >= least:
                x, y, m = (w[a : a + BATCH] for w in windows)
                adam.step(mine._gradients(x, mine.classes[y], m), rate)
                a += BATCH
            return tuple(w[a:] for w in windows)

        rest = None
        for ids, ends, trains in _chunk_ids(batches, end):
            windows = TrainingWindows(ids, ends, end, trains)
            for k in range(number * passes, (number + 1) * passes) if len(windows) else ():
                part = np.random.default_rng(k // ROUNDS).permutation(len(windows))[k % ROUNDS :: ROUNDS]
                new = windows.take(part)
                rest = steps(new if rest is None else tuple(np.concatenate(w) for w in zip(rest, new, strict=True)), BATCH)
        if rest is not None:
            steps(rest, 1)
        if adam.steps:
            rows = np.flatnonzero(adam.met)
            moved = mine.p["e"][rows] - old.p["e"][rows]
            cuts = np.searchsorted(rows, np.arange(0, end + 1 + ROWS, ROWS))
            for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a < b:
                    yield _moves(part, task, rows[a:b] - part * ROWS, adam.met[rows[a:b]], moved[a:b].astype(np.float16))
            yield _moves(-1, task, np.zeros(1), np.array([adam.steps]), np.concatenate([(mine.p[k] - old.p[k]).ravel() for k in names]))
        release()

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple] = {}
        for batch in batches:
            for part, rows, met, moved in zip(*(batch.column(c).to_pylist() for c in ("part", "rows", "met", "moved")), strict=True):
                rows, met = np.frombuffer(rows, np.uint32), np.frombuffer(met, np.float32)
                moved = np.frombuffer(moved, np.float32 if part < 0 else np.float16).reshape(len(rows), -1)
                many, total = sums.setdefault(part, (np.zeros(1 if part < 0 else ROWS), np.zeros((1 if part < 0 else ROWS, moved.shape[1]))))
                many[rows] += met
                total[rows] += met[:, None] * moved
        for part, (many, total) in sums.items():
            rows = np.flatnonzero(many)
            yield _moves(part, 0, rows, many[rows], total[rows] / many[rows, None], np.float32)

    moves = chunks.select("n_docs", "trains", "ids", "id_ends").mapInArrow(learn, kind)
    for row in moves.repartition("part").sortWithinPartitions("part", "task").mapInArrow(average, kind).collect():
        moved = np.frombuffer(row.moved, np.float32)
        if row.part >= 0:
            model.p["e"][np.frombuffer(row.rows, np.uint32) + row.part * ROWS] += moved.reshape(-1, WIDTH)
            continue
        for k in names:
            model.p[k] += moved[: model.p[k].size].reshape(model.p[k].shape)
            moved = moved[model.p[k].size :]
    shared.destroy()


def _moves(part: int, task: int, rows: np.ndarray, met: np.ndarray, moved: np.ndarray, dtype: type | None = None) -> pa.RecordBatch:
    binary = [pa.array([x.tobytes()], pa.binary()) for x in (rows.astype(np.uint32), met.astype(np.float32), moved.astype(dtype or moved.dtype))]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task], pa.int32()), *binary], names=["part", "task", "rows", "met", "moved"])


def _id_type(end: int) -> type:
    return np.uint16 if end < 1 << 16 else np.uint32


def _chunk_ids(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of each chunk's texts, where each text begins and ends, and which are for training."""
    for batch in batches:
        for k in range(batch.num_rows):
            ends = _unpack(batch.column("id_ends")[k].as_buffer(), np.int64, batch.column("n_docs")[k].as_py() + 1)
            yield _unpack(batch.column("ids")[k].as_buffer(), _id_type(end), int(ends[-1])), ends, np.array(batch.column("trains")[k].as_py(), dtype=bool)
        release()


def _training_ids(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of each chunk's training texts, and where each text begins and ends."""
    for ids, ends, trains in _chunk_ids(batches, end):
        lengths = np.diff(ends)
        yield ids[np.repeat(trains, lengths)], np.concatenate([[0], np.cumsum(lengths[trains])])


def dense_sums(chunks: DataFrame, end: int, size: int, tally: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """``size`` counts, summed over all training texts. ``tally`` adds to a task's counts those of texts in a row, ``end`` before, between and after them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.uint32)
        for ids, ends in _training_ids(batches, end):
            flat = np.full(len(ids) + len(ends), end, dtype=np.int64)
            inner = np.ones(len(flat), dtype=bool)
            inner[ends + np.arange(len(ends))] = False
            flat[inner] = ids
            tally(total, flat)
        for part, a in enumerate(range(0, size, PART)):
            if total[a : a + PART].any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([_pack(total[a : a + PART].astype(np.int64))], pa.binary())], names=["part", "counts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.column("part")[k].as_py()
                counts = _unpack(batch.column("counts")[k].as_buffer(), np.int64, min(PART, size - part * PART))
                if part != at:
                    if held is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([_pack(held)], pa.binary())], names=["part", "counts"])
                    at, held = part, counts.copy()
                else:
                    held += counts
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([_pack(held)], pa.binary())], names=["part", "counts"])

    kind = "part bigint, counts binary"
    counted = chunks.select("n_docs", "trains", "ids", "id_ends").mapInArrow(count, kind).repartition("part").sortWithinPartitions("part").mapInArrow(gather, kind)
    out = np.zeros(size, dtype=np.int64)
    for row in counted.collect():
        out[row.part * PART : (row.part + 1) * PART] = _unpack(row.counts, np.int64, min(PART, size - row.part * PART))
    return out


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes | pa.Buffer, dtype, count: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.frombuffer(pa.decompress(data, decompressed_size=count * width, codec="zstd", asbytes=True), dtype=dtype) if count else np.zeros(0, dtype)


CHUNKS = "chunk bigint, n_docs int, n_words bigint, n_distinct bigint, n_chars bigint, doc_ids array<bigint>, trains array<boolean>, held array<boolean>, ends binary, codes binary, keys binary, counts binary, ids binary, id_ends binary"


def make_chunks(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row for each chunk of ``docs`` (doc_id, text, trains, held), stored: its documents, their words as places in the sorted
    hashes ``keys`` (seeded anew in each call) of the chunk's distinct words, how often each word is in its training texts (of n_chars), and its texts' subword ids."""
    path = tokenizer or default_path()
    seeds = (secrets.randbits(64), secrets.randbits(64))
    rows = docs.select(F.monotonically_increasing_id().alias("chunk"), F.col("doc_id").cast("bigint").alias("doc_id"), "text", "trains", "held")
    schema = pa.schema([("chunk", pa.int64()), ("n_docs", pa.int32()), ("n_words", pa.int64()), ("n_distinct", pa.int64()), ("n_chars", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("trains", pa.list_(pa.bool_())),
                        ("held", pa.list_(pa.bool_())), ("ends", pa.binary()), ("codes", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary()), ("id_ends", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for piece in pieces(batch, "text", CHUNK_BYTES):
                texts = plain(piece.column("text"))
                codes, offsets, distinct = words(texts)
                if pc.any(pc.match_substring(texts, "<|")).as_py():
                    ids, ends = coder.encode(texts)
                else:
                    ids, ends = coder.encode_words(codes, offsets, distinct)
                trains = piece.column("trains").to_numpy(zero_copy_only=False).astype(bool)
                chars = int(pc.utf8_length(texts).to_numpy(zero_copy_only=False)[trains].sum())
                keys = mixed(*word_names(distinct), seeds)
                order = np.argsort(keys)
                rank = np.empty(len(keys), dtype=np.uint32)
                rank[order] = np.arange(len(keys), dtype=np.uint32)
                codes = rank[codes]
                counts = np.bincount(codes[np.repeat(trains, np.diff(offsets))], minlength=len(keys)).astype(np.uint32)
                one = [[piece.column("chunk")[0].as_py()], [piece.num_rows], [len(codes)], [len(keys)], [chars], [piece.column("doc_id").to_pylist()], [trains.tolist()], [piece.column("held").to_pylist()],
                       [_pack(offsets.astype(np.int64))], [_pack(codes)], [keys[order].tobytes()], [_pack(counts)], [_pack(ids.astype(_id_type(coder.vocabulary)))], [_pack(ends.astype(np.int64))]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, schema.types, strict=True)], schema=schema)
            pa.default_memory_pool().release_unused()

    return stored(in_batches(rows, run, CHUNKS, (HELD,)), "chunks")


BODIES = "chunk bigint, part bigint, sums binary, doc_ids array<bigint>, held array<boolean>, n_words bigint, n_docs int, ends binary, codes binary, scores array<double>, subwords array<bigint>"


def scored(chunks: DataFrame, model: AttentionModel) -> DataFrame:
    """``chunks`` with the model's score of each text and its number of subwords, for the join with word counts."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)
    kept = ["doc_ids", "held", "n_words", "n_docs", "ends", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ends = _unpack(batch.column("id_ends")[k].as_buffer(), np.int64, batch.column("n_docs")[k].as_py() + 1)
                ids = _unpack(batch.column("ids")[k].as_buffer(), _id_type(shared.value.end), int(ends[-1]))
                scores = shared.value.log10(ids, ends)
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays(
                    [one.column("chunk"), pa.array([1 << 40], pa.int64()), pa.array([None], pa.binary()), *[one.column(c) for c in kept],
                     pa.array([scores.tolist()], pa.list_(pa.float64())), pa.array([(np.diff(ends) + 1).tolist()], pa.list_(pa.int64()))],
                    names=["chunk", "part", "sums", *kept, "scores", "subwords"])
            release()

    return chunks.select("chunk", *kept, "ids", "id_ends").mapInArrow(run, BODIES)


def sum_counts(chunks: DataFrame, range_words: int = RANGE_WORDS) -> DataFrame:
    """chunk, part, sums, stored: for each chunk, the corpus counts of its words in order of ``part``. Rows with chunk -1
    hold what one range has of distinct words and of all words."""
    total = chunks.agg(F.coalesce(F.sum("n_distinct"), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // range_words))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, n, raw, packed in zip(*(batch.column(c).to_pylist() for c in ("chunk", "n_distinct", "keys", "counts")), strict=True):
                keys, counts = np.frombuffer(raw, dtype=np.uint64), _unpack(packed, np.uint32, n)
                part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                cuts = np.flatnonzero(np.diff(part, prepend=-1)) if n else np.zeros(0, np.int64)
                ends = np.append(cuts[1:], n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cuts].astype(np.int64)), pa.array([chunk] * len(cuts), pa.int64()), pa.array([keys[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                     pa.array([counts[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], names=["part", "chunk", "keys", "counts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for part, chunk, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "keys", "counts")), strict=True):
                if part != at and held:
                    yield _summed(at, held)
                    held = []
                at = part
                held.append((chunk, np.frombuffer(keys, dtype=np.uint64), np.frombuffer(counts, dtype=np.uint32)))
        if held:
            yield _summed(at, held)

    packed = chunks.select("chunk", "n_distinct", "keys", "counts").mapInArrow(split, "part bigint, chunk bigint, keys binary, counts binary")
    ordered = packed.repartition("part").sortWithinPartitions("part", "chunk")
    return stored(ordered.mapInArrow(gather, "chunk bigint, part bigint, sums binary, distinct_words bigint, all_words bigint"), "sums")


def _summed(part: int, held: list) -> pa.RecordBatch:
    keys, index = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
    sums = np.bincount(index, weights=np.concatenate([h[2] for h in held]), minlength=len(keys)).astype(np.int64)
    ends = np.cumsum([0] + [len(h[1]) for h in held])
    each = [sums[index[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    n = len(held)
    return pa.RecordBatch.from_arrays(
        [pa.array([h[0] for h in held] + [-1], pa.int64()), pa.array([part] * (n + 1), pa.int64()), pa.array([*each, None], pa.binary()),
         pa.array([None] * n + [int((sums > 0).sum())], pa.int64()), pa.array([None] * n + [int(sums.sum())], pa.int64())],
        names=["chunk", "part", "sums", "distinct_words", "all_words"])


def score(docs: DataFrame, model: AttentionModel, tokenizer: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords for each row of ``docs``
    (doc_id, text, trains, held). Null and empty texts are their end alone; repeated rows are returned each."""
    return score_chunks(make_chunks(docs, tokenizer), model)


def score_chunks(chunks: DataFrame, model: AttentionModel) -> DataFrame:
    sums = sum_counts(chunks)
    seen, total = sums.where("chunk = -1").agg(F.coalesce(F.sum("distinct_words"), F.lit(0)), F.coalesce(F.sum("all_words"), F.lit(0))).first()
    texts = chunks.agg(F.coalesce(F.sum(F.size(F.filter("trains", lambda t: t))), F.lit(0))).first()[0]
    distinct, total = seen + (texts > 0), total + texts
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_subwords"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_all = np.log10(total + distinct + 1)
        end = np.log10(texts + 1) - log_all
        held: list[bytes] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("sums", "doc_ids", "held", "n_words", "n_docs", "ends", "codes", "scores", "subwords")]
            for sums_, doc_ids, out, n_words, n_docs, ends, codes, scores, subwords in zip(*columns, strict=True):
                if sums_ is not None:
                    held.append(sums_)
                    continue
                counts = np.frombuffer(b"".join(held), dtype=np.int64)
                held = []
                offsets, place = _unpack(ends, np.int64, n_docs + 1), _unpack(codes, np.uint32, n_words)
                base = row_sums((np.log10(counts + 1.0) - log_all)[place], offsets) + end
                known = row_sums((counts > 0).astype(np.float64)[place], offsets).astype(np.int64) + (texts > 0)
                rows = [doc_ids, out, np.diff(offsets) + 1, known, np.full(n_docs, total), base, scores, subwords]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, types, strict=True)], names=names)

    bodies = scored(chunks, model)
    both = bodies.unionByName(sums.where("chunk >= 0").select("chunk", "part", "sums"), allowMissingColumns=True)
    ordered = both.repartition("chunk").sortWithinPartitions("chunk", "part").drop("chunk", "part")
    return ordered.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_subwords bigint")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns where crc32(doc_id) mod 7 is not 2 (null doc_id: never) and scores every row."""
    rest = crc_mod(F.col("doc_id"), 7)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(rest != 2, F.lit(False)).alias("trains"), F.coalesce(rest == 2, F.lit(False)).alias("held"))
    chunks = make_chunks(docs)
    return score_chunks(chunks, train_on(chunks))
