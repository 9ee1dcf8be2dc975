"""Language rejection keeps clean texts of any length and lets go of what is in no learned language."""

import random
import zlib

import pyarrow as pa
import pytest

from memloom.llm import langid

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect() if r.text and r.lang and zlib.crc32(str(r.doc_id).encode()) % 5]
    random.Random(1).shuffle(rows)
    sample, seen = set(), dict.fromkeys({r[0] for r in rows}, 0)
    for lang, text in rows:
        if seen[lang] < 400_000:
            sample.add((lang, text))
            seen[lang] += len(text)
    return langid.Identifier(sorted(sample)), {k: " ".join(t for x, t in rows if x == k) for k in seen}


@pytest.mark.parametrize("size", [100, 1000, 30_000, 1_000_000, 8_000_000])
def test_clean_texts_stay(learned, size):
    identifier, texts = learned
    for lang, text in texts.items():
        long = text * (size // len(text) + 1)
        shuffled = list(long[:min(size, 200_000)])
        random.Random(2).shuffle(shuffled)
        names, _, _, rejected = identifier.predict(pa.array([long[:size], "".join(shuffled), "Собака бежит по дороге домой. " * (size // 30 + 1)]))
        assert names[0] == lang and rejected.tolist() == [False, True, True]


def test_length_alone_rejects_nothing(learned):
    """A text that deviates a little is not rejected for being long: its deviation in units of its length levels off."""
    identifier, _ = learned
    import numpy as np

    lengths = np.array([1e2, 1e4, 1e6, 1e9])
    deviation = identifier._deviation(np.full(4, identifier.centres[0] + 0.06), lengths, np.zeros(4, dtype=int))
    assert (deviation < identifier.most / 3).all()
