"""The operators against brute force, exact round trips and held-out accuracy, on the smallest tables and small fixtures."""

import collections
import hashlib
import html
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from memloom.llm import attention, decontam, htmltext, jaccard, langid, lmscore, mixing, mpeg, pii, records, subwords, textio, toxicity
from memloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").toPandas()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), c.sql(SQL[name]).df()
    columns = sorted(got.columns)
    tidy = lambda f: sorted(str(tuple(None if pd.isna(v) else v for v in r)) for r in f[columns].astype(object).itertuples(index=False, name=None))
    assert columns == sorted(want.columns) and tidy(got) == tidy(want)


def test_poisson_counts(spark):
    rows = spark.createDataFrame([(i, "s") for i in range(4000)], "doc_id long, source string")
    got = mixing.mix(rows, rows=10_000).groupBy("doc_id").count().toPandas()["count"]
    assert abs(got.sum() / 4000 - 2.5) < 0.1 and abs((got**2).sum() / 4000 - (2.5 + 2.5**2)) < 0.5
    high = mixing.mix(rows.limit(50), rows=50 * 80).groupBy("doc_id").count().toPandas()["count"]
    assert abs(high.mean() - 80) < 3


def test_salted_mixing_is_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "ab"[i % 3 > 0]) for i in range(200)], "doc_id long, source string")
    want = sorted(tuple(r) for r in mixing.mix(rows).collect())
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert sorted(tuple(r) for r in mixing.mix(rows).collect()) == want


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hits = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hits >= 0.8 * got.toxic.sum() and hits >= 0.95 * got.predicted.sum()


def test_pairs_beyond_weights():
    """Two terms that tell the label together alone: a linear model can't, the machine can."""
    terms = [np.array(x) for x in ([1], [2], [1, 2], [3]) for _ in range(60)]
    labels = np.array([float(len(t) == 2) for t in terms])
    m = toxicity.FactorizationMachine.fit(terms, labels)
    assert {1, 2} <= set(m.chosen.tolist())
    a, b = np.searchsorted(m.chosen, [1, 2])
    assert m.factors[a] @ m.factors[b] > 0.5


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    items = [[rng.choice(vocab) for _ in range(rng.choice([5, 8, 12, 30, 45]))] for _ in range(30)]
    texts = []
    for i in range(240):
        w = list(items[i % 30])
        for _ in range(rng.randint(0, int(0.3 * len(w)) + 1)):
            k = rng.randrange(len(w))
            rng.choice([lambda k=k: w.__setitem__(k, "new"), lambda k=k: w.insert(k, "more"), lambda k=k: len(w) > 2 and w.pop(k)])()
        texts.append(" ".join([rng.choice(vocab) for _ in range(rng.randint(0, 60))] + w + [rng.choice(vocab) for _ in range(rng.randint(0, 60))]))

    def distance(item, text):
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            new = [i]
            for j, b in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if distance(x, t.split()) <= decontam.most_edits(len(x))}
    got = decontam.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"), block_items=7)
    found = {(r.doc_id, r.item_id): r.edits for r in got.collect()}
    assert set(found) <= want and len(found) >= decontam.RECALL * len(want) > 100
    assert all(distance(items[i], texts[d].split()) == e for (d, i), e in found.items())


def test_pii_against_python(spark):
    texts = ["a@b.c.d_x@y.z mail", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255", "4111 1111 1111 1111, 4111-1111-1111-1112 12345678901234567890", "+49 (170) 123-4567. +1 2 +12345678901234567", "é@x.y +é ü1.1.1.1é", "x" * 5000 + "@" + "a.b" * 3000, "1 " * 4000, "a@b@c.d a@-.-", "+1" * 3000]
    texts += ["".join(random.Random(i).choice("a1@.+- ()é4") for _ in range(200)) for i in range(300)]
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = [f"{k}:{m.start()}:{m.end()}" for k, p in plain.items() for m in re.finditer(p, t) if ok(k, m[0])]
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t[:80]


def test_disclosing_terms(spark):
    rows = [(i, f"call me at +49 170 123456{i} on my handy" if i % 10 == 0 else f"some text of no number {i}") for i in range(200)]
    terms = {(r.term, r.kind) for r in pii.disclosing(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert ("handy", "phone") in terms and not any(t == "some" for t, _ in terms)
    text = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 10").first().text
    assert "[PHONE]" in text and "handy" not in text


def components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("tiny", [False, True])
def test_jaccard_against_brute_force(spark, docs, tiny, monkeypatch):
    """``tiny``: tiles and groups of a few sets, no broadcasts; near copies around the threshold in large groups."""
    texts = dict(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))
    if tiny:
        for name, value in (("TILE", 2), ("GROUP", 2), ("BLOCK_SETS", 3), ("MOST_BROADCAST", 0), ("COUNTED_AT_ONCE", 500), ("HOT", 2), ("SPLIT", 7)):
            monkeypatch.setattr(jaccard, name, value)
        rng = random.Random(5)
        texts = {}
        for g in range(4):
            base = [f"g{g}w{k}" for k in range(120)]
            for i in range(30):
                w = list(base)
                for _ in range(rng.randint(0, 9)):
                    w[rng.randrange(120)] = f"x{rng.random()}"
                texts[len(texts)] = " ".join(w)
    sets = {i: shingles(t) for i, t in texts.items()}
    want = components(sets)
    got = jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in texts}


def test_bands_and_bounds():
    assert all(abs(jaccard.band(n) - jaccard.band(m)) <= 1 for n in range(1, 400) for m in range(n, min(400, n * 4 // 3) + 1))
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 300, 80).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, 70), rng.integers(0, 300, 5).astype(np.uint64)]))
        if jaccard.similar(a, b):
            assert jaccard.bounded(jaccard.bitmap(a), len(a), jaccard.bitmap(b), len(b))


def test_media(spark, docs):
    got = {r.doc_id: r for r in mpeg.op6_media(spark, SF).collect()}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        data = (t or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))


def test_mpeg_resynchronises():
    data = mpeg.store(b"hello world" * 400)
    whole = mpeg.parse(data)
    assert whole.damaged == 0 and whole.table["kind"] == "Info" and whole.table["frames"] == len(whole.offsets) and whole.seconds == len(whole.offsets) * 576 / 16000
    at = whole.offsets[2]
    cut = mpeg.parse(data[:at] + b"\x00junk\xff\xfb" + data[at:])
    assert len(cut.offsets) == len(whole.offsets) and cut.skipped == 7
    broken = bytearray(data)
    broken[at + 8] ^= 1
    assert mpeg.parse(bytes(broken)).damaged == 1
    tagged = mpeg.parse(data + b"TAG" + b"Song".ljust(30, b"\0") + bytes(95))
    assert tagged.tags["title"] == "Song" and len(tagged.offsets) == len(whole.offsets)
    assert mpeg.parse(b"").offsets == [] and mpeg.parse(b"\xff" * 99).seconds == 0
    assert mpeg.header(bytes([0xFF, 0xFB, 0x90, 0x00])).size == 417 and mpeg.header(bytes([0xFF, 0xFD, 0x90, 0x00])).samples == 1152


def test_records(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(subwords.default_path())
    frame = spark.createDataFrame(docs[["doc_id", "text"]]).repartition(5)
    records.write_records(frame, f"{tmp_path}/r", shard_chars=40_000)
    index = records.indexed(spark, f"{tmp_path}/r")
    got = {r.doc_id: r for r in index.collect()}
    start = 0
    for i, t in sorted(zip(docs.doc_id, docs.text, strict=True)):
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert len({r.shard for r in got.values()}) > 3
    some = index.where("doc_id % 7 = 0").select("shard", "offset", "size")
    assert {r.doc_id: r.ids for r in records.fetch(spark, f"{tmp_path}/r", some).collect()}[7] == [*coder.encode(docs.text[docs.doc_id == 7].iloc[0], add_special_tokens=False).ids, 2]


def test_damaged_records():
    data = records.frame(5, np.array([1, 2, 3]), False) + b"\n"
    assert records.read_frame(data, 0)[0] == 5 and records.read_frame(data, 0)[1].tolist() == [1, 2, 3]
    for k in range(len(data) - 1):
        broken = bytearray(data)
        broken[k] ^= 4
        with pytest.raises(ValueError):
            records.read_frame(bytes(broken), 0)
    with pytest.raises(ValueError):
        records.read_frame(data[:-3], 0)
    assert records.read_frame(records.frame(None, np.array([70_000]), True) + b"\n", 0)[:2] == (None, [70_000])


def test_language_held_out(spark, docs):
    got = langid.op8_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.97 and got.rejected.mean() <= 0.01


def test_language_model_sums_to_one():
    m = langid.LanguageModel({"a": collections.Counter(["ab", "ba", "aab", "b", "bbb"]), "b": collections.Counter(["cd", "ab"])})
    alphabet = {c for w in ("ab", "ba", "aab", "b", "bbb", "cd") for c in w}

    def step(prefix, j):
        cost = lambda w: m.word_costs([w])[0][0][j]
        ends = 2.0 ** -(cost(prefix))
        return ends

    # Words of one letter and their continuations: no language gives more than all probability to a set of words.
    words = [a + b for a in alphabet for b in ["", *alphabet]]
    assert all(0 < sum(step(w, j) for w in words) <= 1.0001 for j in (0, 1))
    identifier = langid.Identifier([("a", "ab ba aab b bbb")])
    names, score, _, rejected = identifier.predict(pa.array(["ab", "", None, "12"]))
    assert names.tolist() == ["a", "und", "und", "und"] and rejected.tolist() == [False, True, True, True] and score[0] == 1


def test_lm_against_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(lmscore, "RANGE_WORDS", 300)
    monkeypatch.setattr(lmscore.sum_counts, "__defaults__", (300,))
    got = {r.doc_id: r for r in lmscore.op9_lm_scores(spark, SF).collect()}
    tokens = {i: [*WORD.findall(lower(t)), "\0end"] for i, t in zip(docs.doc_id.tolist(), docs.text, strict=True)}
    counts = collections.Counter(w for i, x in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    total, distinct = sum(counts.values()), len(counts)
    for i, x in tokens.items():
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in x)
        assert got[i].n_tokens == len(x) and got[i].train_tokens == total and got[i].n_known == sum(counts[w] > 0 for w in x) and abs(got[i].base_score - base) < 1e-6 * abs(base)


def test_attention_against_one_id_at_a_time():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 50, n) for n in (0, 1, 31, 32, 33, 90)]
    m = attention.AttentionModel(texts, 50, steps=30)
    inside = np.exp(m.inside)
    assert all(abs(inside[m.classes == c].sum() - 1) < 1e-4 for c in set(m.classes.tolist()))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    fast = m.log10(np.concatenate(texts), offsets)
    w = attention.WIDTH
    for text, got in zip(texts, fast, strict=True):
        x, y, total = np.concatenate([[50], text]), np.concatenate([text, [50]]), 0.0
        for t in range(len(x)):
            a = 0 if t < attention.WINDOW else ((t - attention.WINDOW) // attention.STRIDE + 1) * attention.STRIDE
            r = m.rows[x[a : t + 1]]
            z = np.exp(r[:, w : 2 * w] @ r[-1, :w] + m.bias[t - a, : t - a + 1])
            h = r[-1, 3 * w + 1 :] + (z @ r[:, 2 * w : 3 * w]) / z.sum()
            h = h + np.maximum(h @ m.head["w1"] + m.head["b1"], 0) @ m.head["w2"]
            logits = h @ m.head["c"] + m.head["b"]
            total += logits[m.classes[y[t]]] - np.log(np.exp(logits).sum()) + m.inside[y[t]]
        assert abs(total / np.log(10) - got) < 1e-3 * max(1, abs(got))


def test_gradients():
    m = attention.AttentionModel.__new__(attention.AttentionModel)
    rng = np.random.default_rng(3)
    draw = lambda *s: rng.normal(size=s) * 0.4
    w, h, c = attention.WIDTH, attention.HIDDEN, attention.CLASSES
    m.p = {"e": draw(9, w), "q": draw(w, w), "k": draw(w, w), "v": draw(w, w), "r": draw(attention.WINDOW), "w1": draw(w, h), "b1": draw(h), "w2": draw(h, w), "c": draw(w, c), "b": draw(c)}
    x, y = rng.integers(0, 9, (3, attention.WINDOW)), rng.integers(0, c, (3, attention.WINDOW))
    mask = np.ones_like(x, dtype=bool)

    def loss():
        p = m.p
        e = p["e"][x]
        z = (e @ p["q"]) @ (e @ p["k"]).transpose(0, 2, 1) / np.sqrt(w) + m._bias(p["r"]).astype(float)
        a = np.exp(z - z.max(2, keepdims=True))
        a /= a.sum(2, keepdims=True)
        o = e + a @ (e @ p["v"])
        o = o + np.maximum(o @ p["w1"] + p["b1"], 0) @ p["w2"]
        t = o @ p["c"] + p["b"]
        return float((np.log(np.exp(t).sum(2)) - np.take_along_axis(t, y[:, :, None], 2)[:, :, 0]).mean())

    grads = m._gradients(x, y, mask)
    for name in ("q", "k", "v", "r", "w1", "w2", "c", "b"):
        at = tuple(int(rng.integers(0, s)) for s in m.p[name].shape)
        old = m.p[name][at]
        m.p[name][at] = old + 1e-4
        up = loss()
        m.p[name][at] = old - 1e-4
        down = loss()
        m.p[name][at] = old
        assert abs((up - down) / 2e-4 - grads[name][at]) < 2e-3 * max(1, abs(grads[name][at])) + 1e-4, name


def test_html_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    got = {r.page_id: r.text for r in htmltext.op10_html_text(spark, SF).collect()}
    for i, page in zip(pages.page_id, pages.html, strict=True):
        a = page.index("<article>") + 9
        e = page.find("</article>")
        body = re.sub(r"<[^>]*$", "", page[a : e if e >= 0 else len(page)])
        parts = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert got[i] == "\n\n".join(p for p in parts if p)


def test_html_rules():
    text = "This is the text of the article that is long enough to be good and has stop words in it."
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><div class="cookie-notice"><p>{text} cookies</p></div><div class="sidebar"><p>{text} side</p></div>
    <div id="main"><h2>Head &amp; line</h2><p>{text}</p><p class="ad">{text} ad</p><p>Short.</p><form><p>{text} form</p></form><script>if (a < b) "</p>"</script><p>{text}<br>Two</p></div>
    <section id="comments"><p>{text} comment</p></section><ul><li><a href="/x">one link</a></li></ul><footer>f</footer></body></html>"""
    assert htmltext.main_text(page) == f"Head & line\n\n{text}\n\nShort.\n\n{text} Two"


def test_word_encoder_is_exact():
    coder = subwords.encoder(subwords.default_path())
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(0x250), *range(0x300, 0x330), *range(0x390, 0x3D0), *range(0x2000, 0x2030), 0x1F600, 0xFB01, 0x3000]]
    texts = ["", None, "it's <|startoftext|> don't a<|endoftext|>b", "ΟΔΟΣ İstanbul ǅ", "word, word. WORD", *["".join(rng.choice(pool) for _ in range(50)) for _ in range(500)]]
    ids, ends = coder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == coder.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_words():
    codes, offsets, distinct = textio.words(pa.array([" A b\x0bA", None, "", "É\x0c\x1c x"]))
    names = distinct.to_pylist()
    assert [[names[c] for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [["a", "b", "a"], [], [], ["É", "\x1c", "x"]]


def test_lm_statistics_cover_all_documents(spark, docs):
    """Shares inside classes count every training document, not a sample, and every id met has a class by its own neighbours."""
    coder = subwords.encoder(subwords.default_path())
    frame = spark.createDataFrame(docs[["doc_id", "text"]]).repartition(5)
    m = lmscore.train(frame, sample_chars=2000)
    ids, ends = coder.encode(pa.array([t for t in docs.text if t is not None]))
    counts = np.bincount(ids, minlength=coder.vocabulary + 1) + 0.5
    counts[-1] += len(ends) - 1
    share = counts / np.bincount(m.classes, weights=counts)[m.classes]
    assert np.allclose(np.exp(m.inside), share, rtol=1e-4)
    assert len(np.unique(ids)) > attention.CLASSES and (m.classes[np.unique(ids)] != attention.CLASSES - 2).all()


def test_jaccard_links_of_every_set(spark, monkeypatch):
    """A group of k like sets has k (k - 1) / 2 links, not a forest of k - 1."""
    for name, value in (("TILE", 3), ("GROUP", 2), ("BLOCK_SETS", 5)):
        monkeypatch.setattr(jaccard, name, value)
    rng, texts = random.Random(8), []
    for g in range(2):
        for _ in range(15):
            w = [f"g{g}w{k}" for k in range(100)]
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(100)] = f"x{rng.random()}"
            texts.append(" ".join(w))
    texts += [texts[3], texts[3].upper(), "alone in the world it is", None]
    sets = [shingles(t) for t in texts]
    like = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    got = {r.doc_id: r for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i, a in enumerate(sets):
        assert got[i].links == len({frozenset(b) for b in sets if like(a, b) and a != b}), i
        assert got[i].linked_rows == sum(like(a, b) for j, b in enumerate(sets) if j != i), i
    assert sum(r.links for r in got.values()) > 4 * len(texts)


def test_poisson_counts_of_high_rates(spark):
    """Mean and variance are the rate, also far above MOST_RATE."""
    rows = spark.createDataFrame([(i, "s") for i in range(3000)], "doc_id long, source string")
    got = mixing.mix(rows, rows=3000 * 223).groupBy("doc_id").count().toPandas()["count"]
    assert abs(got.mean() - 223) < 1.5 and 190 < got.var() < 256


def twins():
    """Two unlike words of 1024 letters that sums over their bytes with any power of two as modulus can't tell apart."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    return a, b


def test_unlike_words_of_equal_sums(spark):
    from tokenizers import Tokenizer

    a, b = twins()
    assert a != b and len(a) == 1024
    coder = Tokenizer.from_file(subwords.default_path())
    docs_ = spark.createDataFrame([(0, a), (1, b), (2, f"{a} x y z w"), (3, f"{b} x y z w"), (4, a)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in records.token_records(docs_).collect()}
    for i, t in enumerate([a, b, f"{a} x y z w", f"{b} x y z w", a]):
        ids = np.array([*coder.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())), i
    assert [r.component_id for r in jaccard.near_duplicates(docs_).orderBy("doc_id").collect()] == [0, 1, 2, 3, 0]
    chunks = lmscore.make_chunks(docs_.selectExpr("doc_id", "text", "doc_id > 2 AS trains", "doc_id <= 2 AS held"))
    assert [r.n_known for r in lmscore.score_chunks(chunks, lmscore.train_on(chunks, sample_chars=3000)).orderBy("doc_id").collect()] == [2, 2, 6, 6, 2]


def test_word_names():
    listed = ["", "a", "a" * 15, "a" * 16, "a" * 17, "é" * 7, "b\x00", "b", *twins()]
    names = set(zip(*[x.tolist() for x in textio.word_names(pa.array(listed))], strict=True))
    assert len(names) == len(listed)
    assert [x.tolist() for x in textio.word_names(pa.array(listed).slice(3, 2))] == [x.tolist() for x in textio.word_names(pa.array(listed[3:5]))]
    assert len(set(textio.mixed(*textio.word_names(pa.array([f"w{i}" for i in range(50_000)])), (3, 5)).tolist())) == 50_000


def test_broken_pages_take_linear_time():
    import time

    for page in ("<a " * 20_000 + '"', "<div></p></nav>" * 20_000, "<svg/>" * 50_000, "<p class='ad'" * 20_000, "<b>" * 50_000, "<!--" * 50_000, "<a href='x" * 20_000):
        began = time.time()
        htmltext.main_text(page)
        assert time.time() - began < 3, page[:20]
    text = "This is the text of the article that is long enough to be good and has stop words in it."
    assert htmltext.main_text(f"<article><p>{text} <math><mi>x</mi>=1</math></p></article>") == f"{text} x=1"


def test_short_items_are_found_as_they_are(spark):
    docs_ = spark.createDataFrame([(1, "so ABC, def it is"), (2, "abc x def")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "abc def"), (8, "it")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.item_words) for r in decontam.leaks(docs_, items).collect()} == {(1, 7, 2), (1, 8, 1)}
    assert decontam.leaks(docs_, items, least_words=2).count() == 1 and decontam.without_leaks(docs_, items).count() == 2


def test_toxicity_score_is_the_plain_sum():
    rng = np.random.default_rng(4)
    names = ["awful", "people", "kind", "day"]
    chosen = np.unique(toxicity.term_ids(names)[:, 0])
    m = toxicity.FactorizationMachine(chosen, -0.3, rng.normal(size=len(chosen)), rng.normal(size=(len(chosen), toxicity.FACTORS)))
    place = {n: int(np.searchsorted(chosen, toxicity.term_ids([n])[0, 0])) for n in names}
    texts = ["Awful people, awful!", "kind day", "", None, "people kind day awful", "nothing known"]
    for text, got in zip(texts, m.score(pa.array(texts)), strict=True):
        held = sorted({place[w] for w in (x.strip(",!").lower() for x in (text or "").split()) if w in place})
        z = m.bias + sum(m.weights[i] for i in held) + sum(m.factors[i] @ m.factors[j] for a, i in enumerate(held) for j in held[a + 1 :])
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-9


def test_language_model_is_kneser_ney():
    """Probabilities of interpolated Kneser-Ney from plain dictionaries, one letter at a time."""
    words_ = collections.Counter({"ab": 3, "aba": 1, "ba": 2, "bb": 1, "abba": 1, "a": 2})
    m = langid.LanguageModel({"x": words_})
    tally = {n: collections.Counter() for n in range(1, langid.ORDER + 1)}
    for w, c in words_.items():
        letters_ = ["^"] * (langid.ORDER - 1) + list(w) + ["$"]
        for i in range(langid.ORDER - 1, len(letters_)):
            tally[langid.ORDER][tuple(letters_[i - langid.ORDER + 1 : i + 1])] += c
    for n in range(langid.ORDER - 1, 0, -1):
        for g in tally[n + 1]:
            tally[n][g[1:]] += 1

    def p(gram):
        if not gram:
            return m.floor
        n = len(gram)
        ones, twos = (sum(v == k for v in tally[n].values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones else 0.5
        same = [v for g, v in tally[n].items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        return max(tally[n][gram] - d, 0) / sum(same) + d * len(same) / sum(same) * p(gram[1:])

    for w in ["ab", "a", "b", "bab", "abab", "ca", "bbb", "aabb", "baab", "c", "abba", "bcb"]:
        letters_ = ["^"] * (langid.ORDER - 1) + list(w) + ["$"]
        want = -sum(math.log2(p(tuple(letters_[i - langid.ORDER + 1 : i + 1]))) for i in range(langid.ORDER - 1, len(letters_)))
        assert abs(m.word_costs([w])[0][0][0] - want) < 1e-3, w


def test_layer_one_checksums():
    allocation = bytes(range(16))
    head = bytes([0xFF, 0xFE, 0xC4, 0xC0])
    h = mpeg.header(head)
    frame = head + mpeg.crc16(head[2:] + allocation).to_bytes(2, "big") + allocation
    frame = frame.ljust(h.size, b"\0")
    assert h.layer == 1 and mpeg.parse(frame * 3).checked == 3 and mpeg.parse(frame * 3).damaged == 0
    assert mpeg.parse(frame + frame[:8] + b"\x77" + frame[9:] + frame).damaged == 1


def test_lm_trains_on_every_text(spark, docs, monkeypatch):
    """The embedding of every id of the corpus moves, and the rounds together take each window as often as they pass."""
    coder = subwords.encoder(subwords.default_path())
    frame = spark.createDataFrame(docs[["doc_id", "text"]]).repartition(5)
    trained = lmscore.train(frame, sample_chars=2000)
    monkeypatch.setattr(lmscore, "ROUNDS", 0, raising=False)
    start = lmscore.train(frame, sample_chars=2000)
    met = np.unique(coder.encode(pa.array([t for t in docs.text if t is not None]))[0])
    assert (trained.rows[met] != start.rows[met])[:, 3 * attention.WIDTH + 1 :].any(axis=1).all()
    texts = [np.arange(n) for n in (0, 1, 31, 32, 33, 90)]
    windows = attention.TrainingWindows(np.concatenate(texts), np.cumsum([0, *map(len, texts)]), 99)
    x, y, mask = windows.take(np.arange(len(windows)))
    assert y[mask].tolist() == [i for t in texts for i in [*t, 99]] and x[mask].tolist() == [i for t in texts for i in [99, *t]]


def test_model_beats_neighbours(spark):
    """Held-out subwords cost less under the attention model than under their own frequencies."""
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in lmscore.op9_lm_scores(spark, sf).collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    coder = subwords.encoder(subwords.default_path())
    ids, ends = coder.encode(pa.array(texts.text.tolist(), pa.string()))
    held = np.array([rows[i].held_out for i in texts.doc_id])
    counts = np.bincount(ids[np.repeat(~held, np.diff(ends))], minlength=coder.vocabulary) + 0.5
    plain = np.log10(counts / counts.sum())
    unigram = sum(plain[ids[ends[k] : ends[k + 1]]].sum() for k in np.flatnonzero(held))
    model = sum(rows[i].score for i, h in zip(texts.doc_id, held, strict=True) if h)
    assert model > 0.85 * unigram
