"""The test tables in the roles a log triage needs: logs, requests, catalogs, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.operators.ordered_scan import block_of
from logtriage.sources.catalog import union_types

LEVELS = {
    "error": "LogLevel.e",
    "purchase": "LogLevel.i",
    "view": "LogLevel.d",
    "click": "LogLevel.analytics",
    "signup": "LogLevel.w",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- logs -----------------------------------------------------------------------------------------


def event_text() -> Column:
    level = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in LEVELS.items()])
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    prefix = F.when(F.col("event_id") % 4 == 3, F.lit("    at ")).otherwise(F.concat(stamp, F.lit(" ")))
    return F.concat(
        prefix, level, F.lit(" [u"), F.col("user_id").cast("string"), F.lit("] "),
        F.col("event_type"), F.lit(" props="), F.col("props"),
    )


def event_lines(spark: SparkSession, sf_dir: str, file: Column | None = None) -> DataFrame:
    """The events as one log (or as one log per `file`), in event order."""
    return read(spark, sf_dir, "events").select(
        (F.lit("events") if file is None else file).alias("file"),
        block_of(F.col("event_id")).alias("block"),
        F.col("event_id").alias("pos"),
        event_text().alias("line"),
    )


def user_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as one log per user."""
    return event_lines(spark, sf_dir, F.concat(F.lit("user-"), F.col("user_id").cast("string")))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as many logs, one per document."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("file"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    ).select("file", block_of(F.col("pos")).alias("block"), F.col("pos").cast("long").alias("pos"), "line")


_LEVEL_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEVELS.items())
_LINE_SQL = f"""CASE WHEN event_id % 4 = 3 THEN '    at ' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || ' ' END
    || CASE event_type {_LEVEL_SQL} END || ' [u' || user_id || '] ' || event_type || ' props=' || props"""
EVENTS_SQL = f"src AS (SELECT 'events' AS file, event_id AS pos, {_LINE_SQL} AS line FROM events)"
USERS_SQL = f"src AS (SELECT 'user-' || user_id AS file, event_id AS pos, {_LINE_SQL} AS line FROM events)"
DOCUMENTS_SQL = """src AS (SELECT CAST(doc_id AS VARCHAR) AS file, unnest(range(len(parts))) AS pos, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""

# --- requests -------------------------------------------------------------------------------------


def _turns(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").where(F.col("role") == role)
    return turns.withColumn("request_id", (F.col("conv_id") * 10 + F.col("turn")).cast("long"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per user turn, about the log of the user with the conversation's number."""
    conv, turn, rid = F.col("conv_id"), F.col("turn"), F.col("request_id")
    word = F.lit
    keywords = (
        F.when(conv % 4 == 0, F.array(word("error")))
        .when(conv % 4 == 1, F.array(word("Error"), word("purchase")))
        .when(conv % 4 == 2, F.array(word("LogLevel.w"), word("view"), word("view")))
        .otherwise(F.array(word("click"), F.concat(word("u"), conv.cast("string"))))
    )
    start = F.when(conv % 3 == 0, "2024-01-05").when(conv % 3 == 2, "2024-01-10")
    end = F.when(conv % 7 == 3, "2024/01/20").when(conv % 4 != 0, "2024-01-20")
    return _turns(spark, sf_dir, "user").select(
        "request_id",
        F.concat(F.lit("user-"), conv.cast("string")).alias("log_file_path"),
        F.col("text").alias("issue_description"),
        keywords.alias("keywords"),
        F.when(conv % 5 == 4, "vector").otherwise("llm").alias("filter_mode"),
        start.alias("start_date"),
        end.alias("end_date"),
        (F.lit(200) + 100 * (rid % 6)).cast("int").alias("max_tokens"),
        (turn % 4).cast("int").alias("context_lines"),
        (conv % 2 == 0).alias("deduplicate"),
        (turn % 3 == 1).alias("prioritize_by_severity"),
    )


REQUESTS_SQL = """req AS (SELECT CAST(conv_id * 10 + turn AS BIGINT) AS request_id, 'user-' || conv_id AS log_file_path,
    text AS issue_description,
    CASE conv_id % 4 WHEN 0 THEN ['error'] WHEN 1 THEN ['Error', 'purchase'] WHEN 2 THEN ['LogLevel.w', 'view', 'view']
      ELSE ['click', 'u' || conv_id] END AS keywords,
    CASE WHEN conv_id % 5 = 4 THEN 'vector' ELSE 'llm' END AS filter_mode,
    CASE conv_id % 3 WHEN 0 THEN '2024-01-05' WHEN 2 THEN '2024-01-10' END AS start_date,
    CASE WHEN conv_id % 7 = 3 THEN '2024/01/20' WHEN conv_id % 4 <> 0 THEN '2024-01-20' END AS end_date,
    200 + 100 * ((conv_id * 10 + turn) % 6) AS max_tokens, turn % 4 AS context_lines,
    conv_id % 2 = 0 AS deduplicate, turn % 3 = 1 AS prioritize_by_severity
    FROM conversations WHERE role = 'user')"""

COLOURS = ("red", "blue", "hot", "cold", "small", "large", "old", "new")
THINGS = ("bolt", "gear", "ring", "rod", "anvil", "plate", "gizmo", "widget")
KINDS = ("STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL")


def _pick(words: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (number % len(words) + 1).cast("int"))


def catalog_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per user turn with keywords of the catalog's vocabulary; some repeat one."""
    rid = F.col("request_id")
    three = F.array(_pick(COLOURS, rid), F.upper(_pick(THINGS, rid)), _pick(KINDS, rid))
    twice = F.concat(three, F.array(F.upper(_pick(COLOURS, rid))))
    return _turns(spark, sf_dir, "user").select(
        "request_id", F.when(rid % 5 == 0, twice).otherwise(three).alias("keywords")
    )


def _list_sql(words: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"list_extract([{listed}], CAST(request_id % {len(words)} + 1 AS INT))"


CATALOG_REQUESTS_SQL = f"""cr AS (SELECT request_id, CASE WHEN request_id % 5 = 0 THEN list_append(three, upper(colour)) ELSE three END AS keywords
    FROM (SELECT request_id, {_list_sql(COLOURS)} AS colour,
      [{_list_sql(COLOURS)}, upper({_list_sql(THINGS)}), {_list_sql(KINDS)}] AS three
      FROM (SELECT CAST(conv_id * 10 + turn AS BIGINT) AS request_id FROM conversations WHERE role = 'user')))"""


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per customer: names and brands of the parts it sent back. Nearly all lists differ."""
    back = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(F.concat_ws(" ", "p_name", "p_brand"), " ")).alias("word"))
    words = back.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return words.groupBy(F.col("o_custkey").cast("long").alias("request_id")).agg(F.array_sort(F.collect_set("word")).alias("keywords"))


ORDER_REQUESTS_SQL = """cr AS (SELECT CAST(o_custkey AS BIGINT) AS request_id, list_sort(list_distinct(list(word))) AS keywords
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_brand, ' ')) AS word FROM part) ON l_partkey = p_partkey
    WHERE l_returnflag = 'R' GROUP BY 1)"""


# --- catalog --------------------------------------------------------------------------------------


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as `components`, suppliers as `errors`, benchmark passages as `docs`."""
    part = read(spark, sf_dir, "part").select(
        F.lit("components").alias("ctx_type"),
        F.col("p_partkey").cast("long").alias("item_pos"),
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"),
        F.concat(F.split("p_name", " "), F.array(F.lower("p_type"), F.lower("p_brand"))).alias("keywords"),
        F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_name", "p_type").alias("description"),
        F.lower("p_type").alias("category"),
        F.array(F.concat(F.col("p_name"), F.lit(".part"))).alias("files"),
    )
    docs = read(spark, sf_dir, "benchmark").select(
        F.lit("docs").alias("ctx_type"),
        F.col("item_id").cast("long").alias("item_pos"),
        F.concat(F.lit("doc-"), F.col("item_id").cast("string")).alias("id"),
        F.array(_pick(COLOURS, F.col("item_id")), _pick(THINGS, F.col("item_id"))).alias("keywords"),
        F.concat(F.lit("Passage on a "), _pick(COLOURS, F.col("item_id") + 1)).alias("description"),
        F.col("text").alias("content"),
    )
    errors = read(spark, sf_dir, "part").select(
        F.lit("errors").alias("ctx_type"),
        F.col("p_partkey").cast("long").alias("item_pos"),
        F.when(F.col("p_partkey") % 10 != 0, F.concat(F.lit("fault-"), F.col("p_partkey").cast("string"))).alias("id"),
        F.array(F.lower("p_brand"), F.lower("p_type")).alias("keywords"),
        F.concat(F.lit("Fault of "), F.col("p_name")).alias("title"),
        F.lower("p_name").alias("description"),
        F.array(F.lit("wear"), F.lower("p_type")).alias("possible_causes"),
        F.array(F.concat(F.lit("replace "), F.col("p_name"))).alias("solutions"),
        F.split("p_name", " ").alias("related_components"),
        F.lit("critical").alias("severity"),
    )
    return union_types([part, docs, errors])


def _item_word_sql(words: tuple[str, ...], shift: int = 0) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"list_extract([{listed}], CAST((item_id + {shift}) % {len(words)} + 1 AS INT))"


CATALOG_SQL = f"""cat AS (
    SELECT 'components' AS ctx_type, CAST(p_partkey AS BIGINT) AS item_pos, 'part-' || p_partkey AS id,
      list_concat(string_split(p_name, ' '), [lower(p_type), lower(p_brand)]) AS keywords, p_name AS title,
      p_name || ' ' || p_type AS description, lower(p_type) AS category, CAST(NULL AS VARCHAR) AS content,
      CAST(NULL AS VARCHAR[]) AS possible_causes, CAST(NULL AS VARCHAR[]) AS solutions,
      CAST(NULL AS VARCHAR[]) AS related_components FROM part
    UNION ALL SELECT 'docs', CAST(item_id AS BIGINT), 'doc-' || item_id,
      [{_item_word_sql(COLOURS)}, {_item_word_sql(THINGS)}], NULL, 'Passage on a ' || {_item_word_sql(COLOURS, 1)},
      NULL, text, NULL, NULL, NULL FROM benchmark
    UNION ALL SELECT 'errors', CAST(p_partkey AS BIGINT), CASE WHEN p_partkey % 10 <> 0 THEN 'fault-' || p_partkey END,
      [lower(p_brand), lower(p_type)], 'Fault of ' || p_name, lower(p_name), NULL, NULL, ['wear', lower(p_type)],
      ['replace ' || p_name], string_split(p_name, ' ') FROM part)"""

# --- answers --------------------------------------------------------------------------------------


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers to the user turn before them."""
    return _turns(spark, sf_dir, "assistant").select(
        (F.col("request_id") - 1).alias("request_id"), F.col("text").alias("response")
    )


ANSWERS_SQL = """ans AS (SELECT CAST(conv_id * 10 + turn - 1 AS BIGINT) AS request_id, text AS response
    FROM conversations WHERE role = 'assistant')"""
