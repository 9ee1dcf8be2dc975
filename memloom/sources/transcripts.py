"""Conversation sources: JSON-lines transcripts and app-server threads, normalised to items and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = "type string, sessionId string, uuid string, timestamp string, isSidechain boolean, isMeta boolean, message struct<role:string,content:string>"
# Openings of text that a host put in, not a user.
INJECTED = ["<system-reminder>", "<local-command-caveat>"]
#: What this engine itself puts around packed memories; text that holds it is none of a user's.
CONTEXT_MARK = "<memory-context>"


def read_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Transcript lines with their file; lines that are no JSON object become rows with ``damaged``. As a stream, the checkpoint
    keeps what was read."""
    raw = (spark.readStream if streaming else spark.read).text(path)
    return parsed(raw.select("value", F.col("_metadata.file_path").alias("file")))


def parsed(raw: DataFrame) -> DataFrame:
    """Transcript lines of rows (file, value), be they of text files or of sources.tailed_lines."""
    return raw.select("file", F.from_json("value", LINE).alias("line")).select("file", "line.*", (F.col("line").isNull() | F.col("line.type").isNull()).alias("damaged"))


def message_text(content: Column) -> Column:
    """The text of a message whose content is a string, or a list of parts of which those of type ``text`` count, one a line."""
    parts = F.from_json(F.when(content.startswith("["), content), "array<struct<type:string,text:string>>")
    listed = F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "\n")
    return F.regexp_replace(F.trim(F.coalesce(listed, content)), "\r\n", "\n")


def items(lines: DataFrame) -> DataFrame:
    """thread_id, item_id, role, text, seen of messages; side chains, meta lines and injected text are left out."""
    text = message_text(F.col("message.content"))
    injected = F.exists(F.array(*[F.lit(x) for x in INJECTED]), lambda x: text.startswith(x)) | text.contains(CONTEXT_MARK)
    kept = lines.where(~F.col("damaged") & ~F.coalesce("isSidechain", F.lit(False)) & ~F.coalesce("isMeta", F.lit(False)) & F.col("type").isin("user", "assistant") & (F.length(text) > 0) & ~injected)
    item_id = F.concat(F.lit("item-"), F.substring(F.sha2(F.concat_ws("\0", "sessionId", "uuid"), 256), 1, 20))
    return kept.select(F.col("sessionId").alias("thread_id"), item_id.alias("item_id"), F.col("message.role").alias("role"), text.alias("text"), F.to_timestamp("timestamp").alias("seen"))


def latest_items(rows: DataFrame) -> DataFrame:
    """Rows once an item, the newest: what arrives twice is applied once."""
    w = Window.partitionBy("thread_id", "item_id").orderBy(F.desc("seen"), F.desc("text"))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def app_turns(rows: DataFrame) -> DataFrame:
    """Turns of app-server items (thread_id, turn_id, turn_status, ordinal, item_type): complete if completed with a user message and
    an agent message, interrupted kept, else partial. Reasoning counts as an item without text."""
    kind = F.when(F.col("item_type") == "userMessage", "user").when(F.col("item_type") == "agentMessage", "agent").otherwise("other")
    flags = rows.groupBy("thread_id", "turn_id", "turn_status").agg(F.count("*").alias("items"), F.max((kind == "user").cast("int")).alias("user"), F.max((kind == "agent").cast("int")).alias("agent"))
    quality = F.when(F.col("turn_status") == "interrupted", "interrupted").when((F.col("turn_status") == "completed") & (F.col("user") == 1) & (F.col("agent") == 1), "complete").otherwise("partial")
    return flags.select("thread_id", "turn_id", "items", quality.alias("quality"))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, bounds: tuple[int, int], partitions: int) -> DataFrame:
    """A table of a relational store, read in ranges of ``column`` by as many tasks; filters and columns are pushed into its SQL."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1])
            .option("numPartitions", partitions).option("fetchsize", 10_000).load())
