"""Personal data: detection by pattern and information-theoretic sanitisation.

Protected entities are e-mail addresses, IPv4 addresses, payment cards and phone numbers.
How strongly a term reveals that a text holds an entity of a kind is estimated from all
documents: the pointwise mutual information of term and kind, as a share of the kind's
information content. It is 1 for a term that never comes without the kind. In texts
that hold the kind, terms above one threshold are generalised, above another removed.

Everything here is DataFrame operations. Places are counted in code points, ends excluded: a
text is split at its matches and the lengths of the parts are summed in order. All results
depend on the text alone, so each distinct text is worked on once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.llm.textio import join_sums, stored, table

# The patterns, made possessive, and tied to the start of a run or the end of the
# last match so that no start inside a run is tried in vain: a run is then read once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

#: A disclosing term is in so many documents with the kind, and its information reaches this share.
LEAST_DOCS, GENERALISE, REMOVE = 5, 0.75, 0.95
LEAST_LETTERS, MOST_LETTERS = 3, 64
KEY = ["k1", "k2"]


def possible(text: Column) -> dict[str, Column]:
    """Cheap conditions that a text must meet to hold an entity of each kind."""
    return {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        "phone": text.contains("+"),
    }


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"\A{part}(?:\.{part}){{3}}\z")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def matches(kind: str, text: Column) -> Column:
    return F.when(possible(text)[kind], F.regexp_extract_all(text, F.lit(KINDS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>"))


def holds(kind: str, text: Column) -> Column:
    return F.exists(matches(kind, text), lambda m: valid(kind, m))


def with_key(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with null texts empty and a 128-bit key of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"))


def places(texts: DataFrame, kind: str, pattern: str, text: Column, found: Column) -> DataFrame:
    """k1, k2, kind, start, end, match of each of ``found`` (the matches of ``pattern`` in ``text``)."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"))
    rows = texts.select(*KEY, F.posexplode(parts).alias("at", "p")).where("p.match IS NOT NULL")
    size = F.length("p.match")
    order = Window.partitionBy(*KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("p.gap") + size).over(order)
    return rows.select(*KEY, F.lit(kind).alias("kind"), end.alias("end"), F.col("p.match").alias("match")).select(
        *KEY, "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match")


def base_spans(texts: DataFrame) -> DataFrame:
    """The entities of ``texts`` (k1, k2, text): k1, k2, kind, start, end."""
    found = []
    for kind, pattern in KINDS.items():
        some = texts.where(possible(F.col("text"))[kind])
        found.append(places(some, kind, pattern, F.col("text"), matches(kind, F.col("text"))).where(valid(kind, F.col("match"))).drop("match"))
    return reduce(DataFrame.unionAll, found)


def disclosing(docs: DataFrame) -> DataFrame:
    """term, kind, share of the kind's information: the terms that reach GENERALISE.

    Counted over all rows of ``docs`` (doc_id, text). Sums are partial before the shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.select(text.alias("text"), *[holds(k, text).cast("int").alias(k) for k in KINDS])
    totals = marked.agg(F.count("*").alias("docs"), *[F.sum(k).alias(k) for k in KINDS])
    terms = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    each = marked.select(F.explode(terms).alias("term"), *KINDS).where(F.length("term").between(LEAST_LETTERS, MOST_LETTERS))
    counts = each.groupBy("term").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in KINDS])
    often = counts.where(reduce(lambda a, b: a | b, [F.col(k) >= LEAST_DOCS for k in KINDS]))
    per_kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("both")) for k in KINDS]))
    of_kind = totals.select("docs", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("held")) for k in KINDS])).alias("t")).select("docs", "t.*")
    joined = often.select("term", "n", per_kind.alias("p")).select("term", "n", "p.*").where(F.col("both") >= LEAST_DOCS).join(F.broadcast(of_kind), "kind")
    # A kind that every document holds has no information to disclose.
    share = F.log2(F.col("docs") * F.col("both") / (F.col("n") * F.col("held"))) / F.log2(F.col("docs") / F.col("held"))
    return joined.where("held < docs").withColumn("share", share).where(F.col("share") >= GENERALISE).select("term", "kind", "share")


def term_spans(texts: DataFrame, base: DataFrame, terms: DataFrame) -> DataFrame:
    """Disclosing terms outside of e-mail addresses, in texts that hold their kind: k1, k2, start, end, share, held."""
    found = matches("email", F.col("text"))
    blank = F.transform(F.arrays_zip(F.split("text", EMAIL, -1).alias("gap"), found.alias("match")),
                        lambda p: F.concat(p["gap"], F.coalesce(F.repeat(F.lit(" "), F.length(p["match"])), F.lit(""))))
    free = F.when(possible(F.col("text"))["email"], F.array_join(blank, "")).otherwise(F.col("text"))
    kinds = base.groupBy(*KEY).agg(F.collect_set("kind").alias("kinds"))
    some = texts.join(kinds, KEY).select(*KEY, "kinds", free.alias("free"))
    word = r"\p{L}+"
    spans = places(some, "term", word, F.col("free"), F.regexp_extract_all("free", F.lit(word), F.lit(0)))
    named = spans.select(*KEY, "start", "end", F.lower("match").alias("term")).where(F.length("term").between(LEAST_LETTERS, MOST_LETTERS))
    hits = named.join(terms.withColumnRenamed("kind", "of"), "term").join(kinds, KEY).where(F.array_contains("kinds", F.col("of")))
    return hits.groupBy(*KEY, "start", "end").agg(F.max("share").alias("share"), F.min("of").alias("of"))


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct texts that may hold entities (k1, k2, text), and all their spans (k1, k2, kind, start, end, share, of)."""
    keyed = with_key(docs)
    guard = reduce(lambda a, b: a | b, possible(F.col("text")).values())
    texts = stored(keyed.where(guard).select(*KEY, "text").dropDuplicates(KEY), "texts")
    base = stored(base_spans(texts), "spans")
    terms = stored(disclosing(docs), "terms")
    more = term_spans(texts, base, terms).select(*KEY, F.lit("term").alias("kind"), "start", "end", "share", "of")
    return texts, base.select("*", F.lit(None).cast("double").alias("share"), F.col("kind").alias("of")).unionAll(more)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans for each row of ``docs`` (doc_id, text).

    Null and empty texts have no spans; repeated rows are returned each; an empty table gives none.
    """
    _, spans = find(docs)
    rank = F.array_position(F.array(*[F.lit(k) for k in [*KINDS, "term"]]), F.col("kind"))
    item = F.struct(rank.alias("rank"), "start", F.concat_ws(":", "kind", "start", "end").alias("name"))
    listed = lambda some: F.array_join(F.transform(F.array_sort(F.collect_list(some)), lambda s: s["name"]), ",")
    per_text = spans.groupBy(*KEY).agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in [*KINDS, "term"]],
        listed(F.when(F.col("kind") != "term", item)).alias("base"), listed(item).alias("spans"))
    # Rows that can't hold an entity are not joined; copies of a text are joined where a hot key can be split.
    keyed = with_key(docs)
    guard = reduce(lambda a, b: a | b, possible(F.col("text")).values())
    met = join_sums(keyed.where(guard).select("doc_id", *KEY), per_text, KEY, "left")
    rows = met.unionByName(keyed.where(~guard).select("doc_id", *KEY), allowMissingColumns=True)
    return rows.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in [*KINDS, "term"]],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, text with entities named by kind, disclosing terms generalised ("[PHONE CONTEXT]") or removed.

    Of spans that overlap, the one that begins first stays, the longer of two that begin together. Null texts become
    empty; repeated rows are returned each; an empty table gives none.
    """
    texts, spans = find(docs)
    to = F.when(F.col("kind") != "term", F.concat(F.lit("["), F.upper("kind"), F.lit("]"))).when(F.col("share") >= REMOVE, F.lit("")).otherwise(
        F.concat(F.lit("["), F.upper("of"), F.lit(" CONTEXT]")))
    chosen = F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), to.alias("to"))))
    apart = F.aggregate(chosen, F.struct(F.lit(0).cast("bigint").alias("last"), F.array().cast("array<struct<start:bigint,stop:bigint,to:string>>").alias("kept")),
                        lambda a, s: F.when(s["start"] < a["last"], a).otherwise(F.struct((-s["back"]).alias("last"), F.concat(a["kept"], F.array(F.struct(s["start"].alias("start"), (-s["back"]).alias("stop"), s["to"].alias("to")))).alias("kept"))))["kept"]
    cuts = texts.join(spans.groupBy(*KEY).agg(apart.alias("cuts")), KEY)
    gap = lambda i: F.when(i == 0, 0).otherwise(F.col("cuts")[i - 1]["stop"])
    parts = F.transform("cuts", lambda c, i: F.concat(F.substring(F.col("text"), (gap(i) + 1).cast("int"), (c["start"] - gap(i)).cast("int")), c["to"]))
    tail = F.substring(F.col("text"), (F.element_at("cuts", -1)["stop"] + 1).cast("int"), F.length("text"))
    clean = cuts.select(*KEY, F.concat(F.array_join(parts, ""), tail).alias("clean"))
    return with_key(docs).join(clean, KEY, "left").select("doc_id", F.coalesce("clean", "text").alias("text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _kind_sql(kind: str, pattern: str, ok: str) -> str:
    return f"""
  SELECT h, '{kind}' AS kind, start, start + length(m) AS stop, m FROM (
    SELECT h, ms[i] AS m, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT h, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT h, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM texts))) WHERE {ok}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda p:
 CASE WHEN p % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), p, 1) AS INTEGER)
 ELSE CAST(substr(reverse({_DIGITS}), p, 1) AS INTEGER) * 2 - CASE WHEN CAST(substr(reverse({_DIGITS}), p, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""

OP4_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS h FROM documents),
texts AS (SELECT DISTINCT h, text FROM docs),
base AS ({_kind_sql('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', 'true')}
  UNION ALL {_kind_sql('ip', '[0-9]+([.][0-9]+)([.][0-9]+)([.][0-9]+)', "list_bool_and(list_transform(string_split(m, '.'), lambda x: TRY_CAST(x AS HUGEINT) <= 255))")}
  UNION ALL {_kind_sql('card', '[0-9]([ -]?[0-9])+', _LUHN)}
  UNION ALL {_kind_sql('phone', '[+][0-9][ ().0-9-]+[0-9]', f'length({_DIGITS}) BETWEEN 9 AND 15')}),
held AS (SELECT DISTINCT h, kind FROM base),
doc_kinds AS (SELECT d.doc_id, d.h, k.kind FROM docs d JOIN held k USING (h)),
text_terms AS (SELECT DISTINCT h, unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')) AS term FROM texts),
doc_terms AS (SELECT d.h, t.term FROM docs d JOIN text_terms t USING (h) WHERE length(term) BETWEEN {LEAST_LETTERS} AND {MOST_LETTERS}),
n_terms AS (SELECT term, count(*) AS n FROM doc_terms GROUP BY term),
n_kinds AS (SELECT kind, count(*) AS held FROM doc_kinds GROUP BY kind),
n_both AS (SELECT term, kind, count(*) AS both_n FROM doc_terms JOIN held USING (h) GROUP BY term, kind),
terms AS (SELECT term, kind FROM n_both JOIN n_terms USING (term) JOIN n_kinds USING (kind), (SELECT count(*) AS total FROM docs)
  WHERE both_n >= {LEAST_DOCS} AND held < total
    AND log2(CAST(total * both_n AS DOUBLE) / (n * held)) / log2(CAST(total AS DOUBLE) / held) >= {GENERALISE}),
blanked AS (SELECT h, list_aggregate(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(repeat(' ', length(ms[i])), '')), 'string_agg', '') AS text FROM (
  SELECT h, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+') AS ms,
         string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+') AS gaps FROM texts WHERE h IN (SELECT h FROM held))),
word_lists AS (SELECT h, regexp_extract_all(text, '\\p{{L}}+') AS ms, string_split_regex(text, '\\p{{L}}+') AS gaps FROM blanked),
word_rows AS (SELECT h, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(range(1, len(ms) + 1)) AS i FROM word_lists),
word_spans AS (SELECT h, m, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY h ORDER BY i) AS BIGINT) AS stop FROM word_rows),
more AS (SELECT DISTINCT w.h, 'term' AS kind, stop - length(m) AS start, stop FROM word_spans w JOIN terms t ON lower(w.m) = t.term JOIN held k ON k.h = w.h AND k.kind = t.kind),
spans AS (SELECT h, kind, start, stop, list_position(['email', 'ip', 'card', 'phone', 'term'], kind) AS r, kind || ':' || start || ':' || stop AS name
  FROM (SELECT h, kind, start, stop FROM base UNION ALL SELECT h, kind, start, stop FROM more)),
per_text AS (SELECT h, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in [*KINDS, 'term'])},
  coalesce(string_agg(name, ',' ORDER BY r, start) FILTER (kind <> 'term'), '') AS base, string_agg(name, ',' ORDER BY r, start) AS spans FROM spans GROUP BY h)
SELECT doc_id, {', '.join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in [*KINDS, 'term'])},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per_text USING (h)
"""
