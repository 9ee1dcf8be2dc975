"""Every operator and stage over rows with nulls, empty and long texts, ties, repeats, clashing columns, and over no rows."""

import corpus_pipeline
import pytest

from memloom.llm import attention, decontam, htmltext, jaccard, langid, lmscore, mixing, mpeg, pii, records, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, __text string, key int, n array<int>"
LONG = " ".join(f"word{i % 97} the of" for i in range(30_000))
ROWS = [
    (1, "The cat sat on the mat and looked at the dog.", "en", "a", 45), (1, "The cat sat on the mat and looked at the dog.", "en", "a", 45), (2, "", "en", "a", 0), (3, None, "en", None, None),
    (None, "Der Hund liegt auf der Matte und schaut die Katze an.", "de", "b", 50), (None, None, None, None, None), (4, "  \n\t ", None, "a", 5), (5, "!!! 123 ???", "en", "b", 11), (6, LONG, "en", "a", len(LONG)),
    (7, LONG, "en", "a", len(LONG)), (8, "one two", "en", "c", 7), (9, "<|endoftext|> mail me a.b@c.org or 10.0.0.1 \u0000 \U0001F600", "en", "c", 40), (10, "el perro y la casa de los que no", "es", "c", 30),
]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame([(*r, 0.5, "clash", 7, [1]) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def item(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat and looked"), (None, "word1 the of word2 the of word3"), (3, None), (4, "a b")], "item_id bigint, text string")


def both(messy, nothing, f, rows=len(ROWS)):
    assert f(nothing).collect() == [] and len(f(messy).collect()) == rows


def test_language_id(messy, nothing):
    for docs in (messy, nothing):
        identifier = langid.fit(docs)
        assert langid.accepted(docs, identifier).columns == docs.columns
        assert langid.identify(docs, identifier, ["doc_id"]).count() == docs.count()
    found = {r.doc_id: r for r in langid.identify(messy, langid.fit(messy), ["doc_id"]).collect()}
    assert found[2].lang_pred == found[3].lang_pred == found[5].lang_pred == "und" and found[5].score == 0 and found[5].rejected


def test_toxicity(spark, messy, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (4, 0)], "doc_id bigint, toxic int")
    both(messy, nothing, lambda d: toxicity.score(d, toxicity.fit(d, labels)))
    assert all(0 <= r.score <= 1 for r in toxicity.score(messy, toxicity.fit(messy, labels.limit(0))).collect())


def test_decontamination(messy, nothing, item):
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(messy, item).collect()}
    assert (1, 1) in found and (6, None) in found and (7, None) in found and not any(i in (3, 4) for _, i in found)
    assert decontam.leaks(nothing, item).collect() == [] and decontam.without_leaks(nothing, item).columns == nothing.columns
    kept = decontam.without_leaks(messy, item)
    assert kept.columns == messy.columns and kept.count() == len(ROWS) - 4
    assert decontam.without_leaks(messy, item.limit(0)).count() == len(ROWS)


def test_pii(messy, nothing):
    both(messy, nothing, pii.detect)
    row = next(r for r in pii.detect(messy).collect() if r.doc_id == 9)
    assert (row.n_email, row.n_ip) == (1, 1)
    both(messy, nothing, pii.sanitise)
    assert "[EMAIL] or [IP]" in next(r for r in pii.sanitise(messy).collect() if r.doc_id == 9).text


def test_jaccard(messy, nothing):
    both(messy, nothing, jaccard.near_duplicates)
    found = {}
    for r in jaccard.near_duplicates(messy).collect():
        found.setdefault(r.doc_id, r)
    assert found[6].component_id == found[7].component_id == 6 and found[2].component_id == 2 and found[2].n_shingles == 0 and found[8].n_shingles == 1
    assert jaccard.keep_one(nothing).columns == nothing.columns and jaccard.keep_one(nothing).count() == 0
    assert jaccard.keep_one(messy).count() == len(ROWS) - 2


def test_media(messy, nothing):
    both(messy, nothing, lambda d: mpeg.media_features(mpeg.with_media(d)))


def test_records(messy, nothing):
    both(messy, nothing, records.token_records)


def test_lm_scores(spark, messy, nothing):
    marked = lambda d: d.selectExpr("doc_id", "text", "coalesce(doc_id % 2 = 0, false) AS trains", "false AS held")
    model = lmscore.train(marked(messy), sample_chars=3000)
    both(messy, nothing, lambda d: lmscore.score(marked(d), model))
    assert isinstance(lmscore.train(marked(nothing)), attention.AttentionModel)


def test_mixing(messy, nothing):
    mixed = mixing.mix(messy, weights={"a": 1.0, "b": 1.0, "": 0.0}, rows=40)
    assert mixed.columns[: len(messy.columns)] == messy.columns and {r.source for r in mixed.collect()} <= {"a", "b"}
    assert mixing.mix(nothing).count() == 0 and mixing.mix(messy).count() > 0


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", 1), (None, None, None, 2), (3, "v", "", 3), (3, "v", "<p" * 1000, 4), (5, "w", "<div>" * 3000 + "x &amp; y", 5)], "page_id bigint, url string, html string, n_chars int")
    found = {(r.page_id, r.n_chars): r.text for r in htmltext.extract(pages).collect()}
    assert found[(1, 1)] == "a" and found[(None, 0)] == "" and found[(5, 5)] == "x & y" and htmltext.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, messy, nothing, item, k, tmp_path):
    item.write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    for docs in (messy, nothing):
        stored = f"{tmp_path}/docs{docs is messy}"
        docs.write.parquet(stored)
        out = stage(spark, spark.read.parquet(stored), str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        assert out.count() <= 40
