"""The whole pipeline against a chain of brute-force stages over the smallest tables."""

import collections
import hashlib
import math
import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa

from memloom.llm import decontam, langid, mixing, subwords
from memloom.llm.textio import crc_mod

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def one_of_each_group(docs):
    """The least doc_id of each group linked at 75 %; texts without words stay."""
    sets = {d: shingles(t) for d, (t, _) in docs.items()}
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(sorted(docs)):
        for j in sorted(docs)[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {d: v for d, v in docs.items() if find(d) == d}


def least_distance(item, text):
    """Word edits from ``item`` to the nearest stretch of ``text``."""
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, a in enumerate(item, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + np.array([a != b for b in text], dtype=np.int64)) if text else np.zeros(0, np.int64)
        out = np.concatenate([[i], new])
        # A deletion chain runs along the row.
        row = np.minimum.accumulate(out - np.arange(len(out))) + np.arange(len(out))
    return int(row.min())


def words(text):
    edges = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„…¡¿"
    return [w for w in (x.strip(edges).lower() for x in WORD.findall(text or "")) if w]


def uniform(text, seed):
    return int(hashlib.md5(f"{seed}:{text}".encode()).hexdigest()[:13], 16) / (1 << 52)


def copies(doc_id, rate):
    u, k, term = uniform(str(doc_id), mixing.SEED), 0, math.exp(-rate)
    total = term
    while u >= total and k < 200:
        k += 1
        term *= rate / k
        total += term
    return k


def test_run_against_a_chain(spark):
    from tokenizers import Tokenizer

    rows = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    identifier = langid.fit(rows.where(crc_mod(rows.doc_id, 5) != 0))
    every = rows.select("doc_id", "text", "source").toPandas()
    _, _, _, rejected = identifier.predict(pa.array(every.text.tolist(), pa.string()))
    docs = {int(d): (t, s) for d, t, s, r in zip(every.doc_id, every.text, every.source, rejected, strict=True) if not r}
    assert len(docs) > 190
    docs = one_of_each_group(docs)
    items = [w for w in (words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()) if len(w) >= decontam.LEAST_WORDS]

    def leaks(text):
        w = words(text)
        # An item within the limit shares most of its words with the text.
        held = collections.Counter(w)
        return any(sum((collections.Counter(x) & held).values()) >= len(x) - decontam.most_edits(len(x)) and least_distance(x, w) <= decontam.most_edits(len(x)) for x in items)

    leaky = {d for d, (t, _) in docs.items() if leaks(t)}
    docs = {d: v for d, v in docs.items() if d not in leaky}
    assert leaky
    sources = collections.Counter(s for _, s in docs.values())
    shares = {s: math.sqrt(n) for s, n in sources.items()}
    rates = {s: round(len(docs) * shares[s] / sum(shares.values()) / n, 9) for s, n in sources.items()}
    want = collections.Counter({d: n for d, (_, s) in docs.items() if (n := copies(d, rates[s]))})
    assert collections.Counter(r.doc_id for r in got) == want
    coder, start = Tokenizer.from_file(subwords.default_path()), 0
    ids = {d: [*coder.encode(docs[d][0] or "", add_special_tokens=False).ids, 2] for d in want}
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], dtype="<u4").tobytes()))
        start += r.n_tokens
