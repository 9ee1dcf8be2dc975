"""Work that op9 must not do twice, and the counts and windows that it takes a shorter way to."""

import numpy as np
import pyarrow as pa

from memloom.llm import attention, subwords


def test_a_full_cache_keeps_the_words_met_last(monkeypatch):
    monkeypatch.setattr(subwords, "CACHE_WORDS", 130)
    coder = subwords.WordEncoder(subwords.default_path())
    often, sent = [f"{a}{b}o" for a in "bdfgk" for b in "aeiou"], []
    run = coder._run
    monkeypatch.setattr(coder, "_run", lambda steps, texts: sent.extend(w for t in texts for w in t.split()) or run(steps, texts))
    for k in range(6):
        texts = [" ".join([*often, *(f"{w}{'xyzuvw'[k]}, {w}7{k}" for w in often[:12])]), None, ""]
        ids, ends = coder.encode(pa.array(texts))
        assert ids[ends[0] : ends[1]].tolist() == coder.tokenizer.from_file(subwords.default_path()).encode(texts[0], add_special_tokens=False).ids and ends[1:].tolist() == [len(ids)] * 3
    assert all(sent.count(w) == 1 for w in often)
    assert len(coder.keys) < 2 * 130 and len(coder.pool) == coder.sizes.sum()


def test_neighbours_against_pairs():
    rng = np.random.default_rng(4)
    end, size = 400, 401
    flat = np.concatenate([[end], *[np.append(rng.integers(0, 30, n) ** 2 % 397 if n else rng.integers(0, 9, 0), end) for n in (0, 1, 50, 900)], rng.integers(0, 300, 2000), [end]])
    counts = np.bincount(flat, minlength=size)
    counts[end] = 0
    common = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
    want = np.zeros((len(common), 2, attention.MARKS), dtype=np.int64)
    mark = {int(t): k for k, t in enumerate(common[: attention.MARKS - 1])}
    place = {int(t): k for k, t in enumerate(common)}
    for a, b in zip(flat[:-1].tolist(), flat[1:].tolist(), strict=True):
        if a != end and b in mark:
            want[place[a], 0, mark[b]] += 1
        if b != end and a in mark:
            want[place[b], 1, mark[a]] += 1
    got = np.zeros(want.size, dtype=np.uint32)
    attention.neighbours(common, size)(got, flat)
    assert (got.reshape(want.shape) == want).all()


def test_windows_of_chosen_texts():
    lengths, chosen = [0, 1, 31, 32, 33, 90], np.array([True, False, True, True, False, True])
    texts = [100 * k + np.arange(n) for k, n in enumerate(lengths)]
    windows = attention.TrainingWindows(np.concatenate(texts).astype(np.uint16), np.cumsum([0, *lengths]), 999, chosen)
    x, y, mask = windows.take(np.arange(len(windows)))
    assert y[mask].tolist() == [i for t, c in zip(texts, chosen, strict=True) if c for i in [*t, 999]]
    assert x[mask].tolist() == [i for t, c in zip(texts, chosen, strict=True) if c for i in [999, *t]]
    assert (x[~mask] == 999).all() and (y[~mask] == 999).all()


def test_scores_with_large_logits():
    """Sums of exponentials that would overflow are taken again with the maximum out."""
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 50, n) for n in (0, 5, 8, 9, 40, 200)]
    m = attention.AttentionModel(texts, 50, steps=20)
    ids, offsets = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    want = m.log10(ids, offsets)
    m.outer = m.outer.copy()
    m.outer[-1] += 120  # the same for all classes: no probability changes
    assert np.allclose(m.log10(ids, offsets), want, rtol=1e-4)
