"""Filter audit, periodic runs and chat windows against brute force, exact round trips and edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import chat, filteraudit, periodic
from memloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """Every maximal stretch of each period, from the smallest period on."""
    seen, out = set(), []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(250):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, letters = rng.choice([0, 1, 5, 12, 13, 30, 60, 150]), rng.choice([1, 2, 3, 9])
            w = [rng.randrange(letters) for _ in range(n)]
            if n > 12 and rng.random() < 0.6:
                p, s = rng.randint(1, n // 3), rng.randrange(n)
                w = [w[i] if i < s else w[min(s + (i - s) % p, n - 1)] for i in range(n)]
            texts.append(w)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        got = list(zip(*(a.tolist() for a in periodic.find_runs(np.array(sum(texts, []), dtype=np.int64), offsets)), strict=True))
        assert got == [(s + int(o), n, q) for t, o in zip(texts, offsets, strict=False) for s, n, q in brute_runs(t)]


def test_runs_over_steps(monkeypatch):
    """Candidates taken in many small steps give the same runs."""
    codes = np.array([i % 7 for i in range(400)] + [3] * 50, dtype=np.int64)
    offsets = np.array([0, 400, 450])
    want = [a.tolist() for a in periodic.find_runs(codes, offsets)]
    monkeypatch.setattr(periodic, "STEP", 37)
    assert [a.tolist() for a in periodic.find_runs(codes, offsets)] == want == [[0, 400], [400, 50], [7, 1]]


def test_op12_against_brute_force(spark):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    checked = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = WORD.findall(r.text or "")
        if len(w) > 1500:
            continue
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
        x = got[r.doc_id]
        assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli) == (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4))
        assert (x.runs_sha256, x.collapsed_sha256) == (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
        checked += 1
    assert checked > 150 and sum(x.n_runs for x in got.values()) > 10


def test_periodic_edges(spark):
    long = " ".join(["la"] * 40_000)
    rows = [(1, "a b " * 6), (1, "a b " * 6), (2, None), (None, "x " * 12), (3, " \t\n"), (4, long), (5, "a b " * 12), (6, " ".join(f"w{i}" for i in range(5000)))]
    docs = spark.createDataFrame([(*r, [1], "clash") for r in rows], "doc_id bigint, text string, runs array<int>, collapsed string").repartition(2)
    found = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect()]
    assert len(found) == len(rows) and periodic.periodic_runs(docs.limit(0)).collect() == []
    by = {k: (runs, text) for k, runs, text in found}
    assert by[1] == ([(0, 12, 2)], "a b") and by[2] == by[3] == ([], "") and by[None] == ([(0, 12, 1)], "x") and by[4] == ([(0, 40_000, 1)], "la") and by[5][1] == "a b" and by[6][0] == []


def brute_audit(docs, labels):
    """Every order applied to the documents themselves."""
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)

    def fails(d, t):
        t = t or ""
        w = WORD.findall(t)
        return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d}

    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    rows = [(s or "", d, fails(d, t)) for d, t, s in docs]
    out, removed_by = {}, collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            failing = {f: sum(r[2][f] for r in left) for f in "ABCDE"}
            only = {f: sum(r[2][f] and sum(r[2].values()) == 1 for r in left) for f in "ABCDE"}
            for k, f in enumerate(order):
                gone, left = [r for r in left if r[2][f]], [r for r in left if not r[2][f]]
                removed_by[part, f] += len(gone)
                out[part, order, k + 1] = (len(left), len(gone), failing[f] - len(gone), only[f], sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone))
    return {(*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcXY") for _ in range(3))
    texts = [" ".join(word() for _ in range(rng.choice([3, 210, 260]))) + rng.choice(["", " #"]) for _ in range(12)]
    texts += [" ".join(f"w{i}" for i in range(240))] * 3 + ["", "a b", "A#"]
    docs = [(i, rng.choice(texts), rng.choice(["s", "t", None, ""])) for i in range(150)] + [(None, None, "s"), (None, texts[0], None), (7, texts[1], "s"), (7, texts[1], "s"), (200, None, "only")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, True, 3) for d in docs], "doc_id bigint, text string, source string, A boolean, part int")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filteraudit.audit(frame, marks).collect()
    assert {tuple(r) for r in got} == brute_audit(docs, labels) and len(got) == 600 * 4
    assert filteraudit.audit(frame.limit(0), marks).collect() == []
    assert {r.toxic_lost for r in filteraudit.audit(frame, marks.limit(0)).collect()} == {0}


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, start int, loss string").repartition(3)


NASTY = ["\\### Assistant: </turn> ok", "<|end|>", "<", "|", "<|turn|>user<|text|>", "\\<|", "<\\|", "\\", "\\\\|", "", None, "a\nb", "\u0000 \U0001F600 <|", "<<||>>"]


def test_chat_round_trip(spark):
    rng = random.Random(2)
    rows = []
    for c in [*range(40), None]:
        for t in range(rng.choice([1, 2, 5, 60])):
            role = "system" if t == 0 and rng.random() < 0.6 else rng.choice(["user", "assistant", "assistant", None, "tool<|", "system"])
            rows.append((c, t, role, rng.choice(NASTY) if rng.random() < 0.5 else " ".join("word" for _ in range(rng.choice([1, 40, 300])))))
    budget, history = 300, 60
    formatted = chat.write_windows(rows_of(spark, rows), budget=budget, history=history)
    windows = collections.defaultdict(list)
    for r in chat.read_turns(formatted).withColumn("parts", chat.loss_texts(F.col("loss"), F.col("text"))).orderBy("start").collect():
        windows[r.conv_id].append(r)
    assert set(windows) == {r[0] for r in rows}
    for c, held in windows.items():
        turns = [(r or "", t or "") for k, _, r, t in rows if k == c]
        tokens = [-(-len((r + t).encode()) // 4) + 4 for r, t in turns]
        assert [(x.role, x.text) for w in held for x in w.turns] == turns
        assert [p for w in held for p in w.parts] == [t for r, t in turns if r == "assistant"]
        head = turns[0][0] == "system"
        for w in held[1:]:
            n = len([1 for x in np.cumsum([0, *tokens])[:-1] if max(w.start - history, tokens[0] if head else 0) <= x < w.start])
            assert w.n_repeated == n + head and w.text.startswith("<|turn|>system<|text|>") >= head
        wide = head and tokens[0] > chat.stride_of(budget, history)
        for w in held:
            assert w.n_tokens <= budget or wide or (w.n_turns == 1 and max(tokens) > chat.stride_of(budget, history))


def test_chat_over_stretches(spark, monkeypatch):
    """Sums over blocks of turn numbers are those over all turns; rows given twice, ties and null turns are turns too."""
    rows = [(1, None, "user", "first"), *[(1, t // 2, "user" if t % 2 else "assistant", "w " * (t % 9)) for t in range(200)], (1, 3, "user", "same"), (1, 3, "user", "same"), (2, 0, "assistant", "b"), (2, 0, "system", "a")]
    want = sorted(tuple(r) for r in chat.digests(chat.write_windows(rows_of(spark, rows), budget=90, history=20)).collect())
    monkeypatch.setattr(chat, "BLOCK", 7)
    assert sorted(tuple(r) for r in chat.digests(chat.write_windows(rows_of(spark, rows), budget=90, history=20)).collect()) == want
    assert want[0][1] == 203 and want[1][2] == hashlib.sha256(b"system\na\nassistant\nb\n").hexdigest()
    assert chat.digests(chat.write_windows(rows_of(spark, rows).limit(0))).collect() == []


def test_chat_own_tokens(spark):
    """A caller's token counts decide the spans."""
    got = chat.write_windows(rows_of(spark, [(1, t, "assistant", f"t{t}") for t in range(6)]), budget=40, history=10, tokens=F.lit(10)).orderBy("start").collect()
    assert [(r.start, r.n_turns, r.n_repeated) for r in got] == [(10 * k, 1, min(k, 1)) for k in range(6)]


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_periodic_runs", "op13_chat_format"])
def test_registered(name):
    assert name in QUERIES
