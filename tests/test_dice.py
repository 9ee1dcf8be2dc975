"""Like sets by products of blocks, against brute force."""

import random

import numpy as np

from memloom.operators import capture, dice


def brute(left, right, least):
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)} if len(t) > 2 else ({t} if t else set())
    out = []
    for i, kind, a in left:
        for j, other, b in right:
            x, y = grams(a), grams(b)
            if kind == other and x and y and round(2 * len(x & y) / (len(x) + len(y)), 6) >= least:
                out.append((i, j, round(2 * len(x & y) / (len(x) + len(y)), 6)))
    return sorted(out)


def texts(seed, n, letters="abcd"):
    r = random.Random(seed)
    return [(f"{seed}-{i}", r.choice(["x", "y"]), "".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 3, 9, 30])))) for i in range(n)]


def test_pairs_of_several_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(dice, "GROUP", 20)
    monkeypatch.setattr(dice.blocks, "__defaults__", (7,))
    left, right = texts(1, 60), texts(2, 90, "abcdé𝒳語")
    got = capture.similar_pairs(spark.createDataFrame(left, "id string, kind string, value string"), spark.createDataFrame(right, "id string, kind string, value string"))
    assert sorted(map(tuple, got.collect())) == brute(left, right, capture.SIMILAR)


def test_shared_counts_with_rare_elements_and_several_products(monkeypatch):
    monkeypatch.setattr(dice, "PRODUCT", 3)
    monkeypatch.setattr(dice, "RARE", 20)
    rng = np.random.default_rng(3)
    sets = lambda n: [np.unique((rng.pareto(1, rng.integers(1, 9)) * 3).astype(np.int64)) for _ in range(n)]
    a, b = sets(40), sets(30)
    size = lambda s: np.array([len(x) for x in s])
    got = dice.shared_counts(size(a), np.concatenate(a), size(b), np.concatenate(b))
    assert got.tolist() == [[float(len(np.intersect1d(x, y))) for y in b] for x in a]


def test_no_row_for_a_pair_that_is_not_alike(spark, monkeypatch):
    """Texts that share most of their commonest bigrams but are not alike: what is shuffled and written does not grow with their pairs."""
    written = []
    plain = dice.stored
    monkeypatch.setattr(dice, "stored", lambda df, what: written.append(plain(df, what)) or written[-1])
    r = random.Random(5)
    rows = [(f"{i}", "x", "".join(r.choice("abcdefghijkl") for _ in range(60))) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, kind string, value string")
    got = capture.review(df, df.selectExpr("*", "1 AS version"))
    assert got.where("action = 'link_duplicate'").count() == 400
    assert sum(w.count() for w in written) <= 2 * 4 + 2  # blocks alone: one a partition and kind


def test_review_takes_the_best_by_similarity_version_and_id(spark):
    rows = [(f"{i:02d}", "x", "some text that is held" + "abcdefgh"[i % 3], i // 6) for i in range(24)]
    held = spark.createDataFrame(rows, "id string, kind string, value string, version int")
    got = capture.review(spark.createDataFrame([("q", "x", "some text that is held!")], "id string, kind string, value string"), held).collect()
    want = sorted(rows, key=lambda r: (-next(s for _, j, s in brute([("q", "x", "sometextthatisheld")], [(r[0], "x", r[2].replace(" ", ""))], 0.5)), -r[3], r[0]))[:5]
    assert [r.right_id for r in sorted(got, key=lambda r: r.place)] == [w[0] for w in want]
