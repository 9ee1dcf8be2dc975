"""Chat formatting: conversations cut at turns into windows of a token budget, with a loss mask.

Prefix sums of turn tokens choose the spans: a turn belongs to the stride of tokens in which it begins, and a turn longer than
a stride is a span of its own. A window is the conversation's system turn, the turns of up to ``history`` tokens
before its span, and the span. Only assistant turns of the span bear loss: what a window repeats is masked, so each
assistant text bears loss once.

The stride is a third of what the budget leaves beside the history, so that a system turn, a stride and the turn that
overhangs it fit together. A system turn longer than a stride is still retained: strides are then as long as it is, so
that windows pass the budget (``n_tokens``) but no conversation grows without bound by repeats. No turn is ever cut.

Everything here is DataFrame operations. Sums are formed for blocks of turn numbers and then within a block, and a window meets its
history by the stretch of tokens that both lie in, so no task needs a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.llm.textio import delete_stored, join_sums, shared_path, stored, table

#: Tokens of a window, and those of them that may repeat earlier turns.
BUDGET, HISTORY = 1024, 256
#: Tokens that the marks of a turn count as, and turn numbers of a block.
MARK_TOKENS, BLOCK = 4, 256
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
FIRST = -(1 << 63)


def escape(text: Column) -> Column:
    """No ``<|`` is left: a backslash is put before each backslash, and before the bar of a ``<|``."""
    return F.regexp_replace(text, r"\\|(?<=<)\|", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def estimated_tokens(role: Column, text: Column) -> Column:
    """A token for four bytes, rounded up, and those of the marks."""
    return (F.ceil((F.octet_length(role) + F.octet_length(text)) / 4) + MARK_TOKENS).cast("bigint")


def stride_of(budget: int, history: int) -> int:
    return max((budget - history) // 3, 1)


def turns_of(conversations: DataFrame, tokens: Column | None) -> DataFrame:
    """conv (a struct, so that a null id is a key like others), place, block, role, text, tokens, system."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    place = F.coalesce(F.col("turn").cast("bigint"), F.lit(FIRST))
    return conversations.select(
        F.struct(F.col("conv_id")).alias("conv"), place.alias("place"), F.floor(place / BLOCK).cast("bigint").alias("block"), role.alias("role"), text.alias("text"),
        (estimated_tokens(role, text) if tokens is None else tokens.cast("bigint")).alias("tokens"), (role == "system").alias("system"))


def placed_turns(turns: DataFrame, stride: int) -> tuple[DataFrame, DataFrame]:
    """The turns with the tokens before them (``before``), the span they are in (``span``) and whether they are the
    conversation's system turn (``head``), role and text escaped; and the system turns (conv, text, tokens)."""
    sums = turns.groupBy("conv", "block").agg(F.sum("tokens").alias("sum"), F.count_if(F.col("tokens") > stride).alias("long"), F.min("place").alias("first"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.select("conv", "block", "first", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("sum", "long")])
    firsts = sums.groupBy("conv").agg(F.min("first").alias("place"))
    systems = turns.where("system").select("conv", "place", "text", "tokens").join(firsts, ["conv", "place"]).groupBy("conv").agg(F.min(F.struct("text", "tokens")).alias("s")).select("conv", "s.*")
    framed = blocks.join(systems.select("conv", F.col("tokens").alias("system_tokens")), "conv", "left")
    order = Window.partitionBy("conv", "block").orderBy("place", ~F.col("system"), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    long = (F.col("tokens") > stride).cast("bigint")
    rows = turns.join(framed, ["conv", "block"]).select("*", (F.col("sum_before") + so_far(F.col("tokens"))).alias("before"), (F.col("long_before") + so_far(long)).alias("longs"))
    wide = F.coalesce(F.col("system_tokens") > stride, F.lit(False))
    apart = F.when(wide, F.lit(0)).otherwise(2 * F.col("longs") + long)
    nth = F.floor(F.col("before") / F.greatest(F.lit(stride), F.coalesce("system_tokens", F.lit(0))))
    placed = rows.select("conv", "before", F.struct(nth.cast("bigint").alias("nth"), apart.cast("bigint").alias("apart")).alias("span"), ((F.col("before") == 0) & F.col("system")).alias("head"),
                         escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), "tokens")
    return placed, systems


def windows(placed: DataFrame, systems: DataFrame, history: int) -> DataFrame:
    """conv, start (tokens of the conversation before the window's own turns: its place), n_turns (its own), n_repeated, n_tokens, text, loss."""
    starts = placed.groupBy("conv", "span").agg(F.min("before").alias("start"))
    own = join_sums(placed, starts, ["conv", "span"]).select("conv", "start", "before", "role", "text", "tokens")
    later = starts.where("start > 0").select("conv", "start")
    some = F.array_distinct(F.array(F.floor(F.col("start") / history) - 1, F.floor((F.col("start") - 1) / history)))
    wanted = later.withColumn("stretch", F.explode(some))
    told = placed.where("NOT head").withColumn("stretch", F.floor(F.col("before") / history))
    near = (F.col("before") < F.col("start")) & (F.col("before") >= F.col("start") - history)
    repeated = told.join(wanted, ["conv", "stretch"]).where(near).select("conv", "start", "before", "role", "text", "tokens")
    head = join_sums(later, systems.select("conv", escape(F.col("text")).alias("text"), "tokens"), ["conv"]).select("conv", "start", F.lit(0).cast("bigint").alias("before"), F.lit("system").alias("role"), "text", "tokens")
    turns = F.array_sort(F.collect_list(F.struct("before", "role", "text", "tokens")))
    held = own.unionAll(repeated).unionAll(head).groupBy("conv", "start").agg(turns.alias("turns"))
    lead = lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT))
    text = F.array_join(F.transform("turns", lambda t: F.concat(lead(t), t["text"], F.lit(END))), "")
    sizes = F.transform("turns", lambda t: F.struct(F.length(lead(t)).alias("lead"), F.length(t["text"]).alias("body"), ((t["before"] >= F.col("start")) & (t["role"] == "assistant")).alias("target")))
    begin = lambda a, s: (a["at"] + s["lead"]).cast("int")
    spans = "array<struct<start:int,stop:int>>"
    loss = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans")), lambda a, s: F.struct(
        (begin(a, s) + s["body"] + len(END)).cast("int").alias("at"),
        F.when(s["target"], F.concat(a["spans"], F.array(F.struct(begin(a, s).alias("start"), (begin(a, s) + s["body"]).cast("int").alias("stop"))))).otherwise(a["spans"]).alias("spans")))["spans"]
    count = F.size(F.filter("turns", lambda t: t["before"] >= F.col("start")))
    return held.select("conv", "start", count.alias("n_turns"), (F.size("turns") - count).alias("n_repeated"), F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, t: a + t["tokens"]).alias("n_tokens"), text.alias("text"), loss.alias("loss"))


def write_windows(conversations: DataFrame, path: str | None = None, budget: int = BUDGET, history: int = HISTORY, tokens: Column | None = None) -> DataFrame:
    """Write the windows of ``conversations`` (conv_id, turn, role, text) as Parquet and read them back: conv_id, start, n_turns,
    n_repeated, n_tokens, text, loss (code-point spans of ``text``).

    ``tokens``: tokens of a row (an estimate from its bytes by default). Rows are ordered by turn (null first), ties by the system
    turn first, then role and text; rows repeated in full are turns each. The system turn is the first turn, where its role is
    ``system``. Null roles and texts are empty; rows of a null conv_id are one conversation; other columns are not read; an empty table gives none.
    """
    spark = conversations.sparkSession
    placed, systems = placed_turns(turns_of(conversations, tokens), stride_of(budget, history))
    kept, heads = stored(placed, "turns"), stored(systems, "systems")
    path = path or shared_path(spark, "chat")
    windows(kept, heads, history).select("conv.conv_id", "start", "n_turns", "n_repeated", "n_tokens", "text", "loss").write.option("compression", "zstd").parquet(path)
    delete_stored(kept)
    delete_stored(heads)
    return spark.read.parquet(path)


def read_turns(formatted: DataFrame) -> DataFrame:
    """The columns of ``formatted`` and ``turns``: role and text, unescaped, of each window's own turns."""
    marked = F.slice(F.split("text", r"<\|turn\|>", -1), F.col("n_repeated") + 2, F.col("n_turns"))
    body = lambda t: F.substring_index(t, TEXT, -1)
    return formatted.withColumn("turns", F.transform(marked, lambda t: F.struct(
        unescape(F.substring_index(t, TEXT, 1)).alias("role"), unescape(F.substring(body(t), F.lit(1), F.length(body(t)) - len(END))).alias("text"))))


def loss_texts(loss: Column, text: Column) -> Column:
    """The texts under the mask, unescaped."""
    return F.transform(loss, lambda s: unescape(F.substring(text, s["start"] + 1, s["stop"] - s["start"])))


def digests(formatted: DataFrame) -> DataFrame:
    """What the windows of each conversation hold, read back. The hash of a whole conversation needs it in one place: its windows are
    reduced to their own turns before they meet."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(loss_texts(F.col("loss"), F.col("text")), "")
    parts = read_turns(formatted).select("conv_id", "start", "n_turns", F.length("text").alias("chars"), told.alias("told"), loss.alias("loss"))
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", c))), lambda p: p[c]), "")
    return parts.groupBy("conv_id").agg(
        F.sum("n_turns").cast("bigint").alias("n_turns"), F.sha2(in_order("told"), 256).alias("turns_sha256"), F.sum(F.length("loss")).cast("bigint").alias("loss_chars"),
        F.sha2(in_order("loss"), 256).alias("loss_sha256"), F.sum("chars").cast("bigint").alias("formatted_chars"))


#: A conversation of control strings, formatted with the others.
PLANTED_ID, PLANTED_TEXT = -7, "\\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = F.explode(F.array(*[F.struct(F.lit(PLANTED_ID).alias("conv_id"), F.lit(i).alias("turn"), F.lit(r).alias("role"), F.lit(PLANTED_TEXT).alias("text")) for i, r in enumerate(("user", "assistant"))]))
    planted = spark.range(1).select(rows.alias("r")).select("r.*")
    return digests(write_windows(given.unionByName(planted)))


_STRIDE = stride_of(BUDGET, HISTORY)
_ESCAPED = "length(replace(replace({0}, chr(92), repeat(chr(92), 2)), '<|', '<' || chr(92) || '|'))"

OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PLANTED_ID}, 0, 'user', '{PLANTED_TEXT}' UNION ALL SELECT {PLANTED_ID}, 1, 'assistant', '{PLANTED_TEXT}'),
sized AS (SELECT *, (strlen(role) + strlen(text) + 3) // 4 + {MARK_TOKENS} AS tokens,
  {len(TURN + TEXT + END)} + {_ESCAPED.format('role')} + {_ESCAPED.format('text')} AS chars FROM turns),
summed AS (SELECT *, coalesce(sum(tokens) OVER earlier, 0) AS before, coalesce(count(*) FILTER (tokens > {_STRIDE}) OVER earlier, 0) AS longs
  FROM sized WINDOW earlier AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role <> 'system', role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
headed AS (SELECT *, before = 0 AND role = 'system' AS head, coalesce(max(CASE WHEN before = 0 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0) AS system_tokens,
  max(CASE WHEN before = 0 AND role = 'system' THEN chars END) OVER (PARTITION BY conv_id) AS system_chars FROM summed),
placed AS (SELECT *, before // greatest({_STRIDE}, system_tokens) AS nth,
  CASE WHEN system_tokens > {_STRIDE} THEN 0 ELSE 2 * longs + CASE WHEN tokens > {_STRIDE} THEN 1 ELSE 0 END END AS apart FROM headed),
starts AS (SELECT conv_id, min(before) AS start, max(system_chars) AS system_chars FROM placed GROUP BY conv_id, nth, apart),
repeated AS (SELECT s.conv_id, sum(p.chars) AS chars FROM starts s JOIN placed p ON p.conv_id IS NOT DISTINCT FROM s.conv_id
  AND p.before < s.start AND p.before >= s.start - {HISTORY} AND NOT p.head GROUP BY s.conv_id),
again AS (SELECT conv_id, sum(system_chars) FILTER (start > 0) AS chars FROM starts GROUP BY conv_id),
own AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY before)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY before) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars FROM placed GROUP BY conv_id)
SELECT o.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(o.chars + coalesce(r.chars, 0) + coalesce(a.chars, 0) AS BIGINT) AS formatted_chars
FROM own o LEFT JOIN repeated r ON r.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN again a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
"""
