"""Queries over chunks and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from logtriage.config import VectorFilterConfig
from logtriage.operators.chunking import chunk_fixed, chunk_log, chunk_recursive
from logtriage.operators.vectors import DIMENSIONS, embed, search, search_batch
from logtriage.plans.vector_filter import build_index, vector_filter, vector_filter_batch, vector_responses
from logtriage.session import new_table_path
from logtriage.sources.index_store import read_index, signature_column, signature_of, write_index
from logtriage.sources.results import hits_json
from workload import filter_sql as q
from workload.log_queries import END, KEPT, START
from workload.registry import query
from workload.tables import (
    DOCUMENTS_SQL,
    EVENTS_SQL,
    REQUESTS_SQL,
    USERS_SQL,
    document_lines,
    event_lines,
    read,
    requests,
    user_lines,
)

# --- chunks ---------------------------------------------------------------------------------------


@query("""SELECT doc_id, j AS chunk_id, j * 600 AS start_index, substr(text, j * 600 + 1, 800) AS text
FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil((length(text) - 200) / 600.0) AS BIGINT)))) AS j FROM documents)""")
def chunk_fixed_windows(spark, sf_dir):
    return chunk_fixed(read(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def chunk_recursive_documents(spark, sf_dir):
    return chunk_recursive(read(spark, sf_dir, "documents"), "doc_id", "text")


def chunks_sql(source: str, keys: str = "file") -> str:
    """Line-packed chunks of a (keys, pos, line) relation, with one global running sum per key."""
    return f"""pieces AS (SELECT {keys}, pos, i AS piece, substr(line, i * 800 + 1, 800) AS line FROM
      (SELECT *, unnest(range(greatest(1, CAST(ceil(length(line) / 800.0) AS BIGINT)))) AS i FROM {source})),
  placed AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY {keys} ORDER BY pos, piece ROWS UNBOUNDED PRECEDING) - length(line) - 1 AS ofs FROM pieces),
  wins AS (SELECT *, unnest(range(greatest(0, CAST(floor((ofs - 800) / 600.0) AS BIGINT) + 1), CAST(floor(ofs / 600.0) AS BIGINT) + 1)) AS chunk_id FROM placed),
  chunks AS (SELECT {keys}, chunk_id, CAST(min(ofs) AS BIGINT) AS start_index, string_agg(line, chr(10) ORDER BY ofs) AS text FROM wins GROUP BY {keys}, chunk_id)"""


@query(f"WITH src AS (SELECT 'events' AS file, event_id AS pos, event_type || ' ' || props AS line FROM events), {chunks_sql('src')} "
       "SELECT chunk_id, start_index, text FROM chunks")
def chunk_log_events(spark, sf_dir):
    line = F.concat_ws(" ", "event_type", "props")
    events = read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), line.alias("line"))
    lines = event_lines(spark, sf_dir).drop("line").join(events, "pos")
    return chunk_log(lines).drop("file")


@query(f"WITH {DOCUMENTS_SQL}, {chunks_sql('src')} SELECT file, chunk_id, start_index, text FROM chunks")
def chunk_log_documents(spark, sf_dir):
    return chunk_log(document_lines(spark, sf_dir))


# --- embeddings and search ------------------------------------------------------------------------


def vectors_sql(name: str, source: str, keys: str, text: str = "text") -> str:
    """Non-zero components of hashed word counts, as single precision unit vectors."""
    return f"""{name} AS (SELECT {keys}, bucket, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {keys})) AS FLOAT) AS v FROM
      (SELECT {keys}, bucket, count(*) AS c FROM (SELECT {keys}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {DIMENSIONS} AS bucket
        FROM (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {source})) GROUP BY ALL))"""


@query(f"WITH {vectors_sql('v', 'documents', 'doc_id')} SELECT doc_id, bucket, round(CAST(v AS DOUBLE), 5) AS weight FROM v")
def embed_documents(spark, sf_dir):
    vectors = embed(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.posexplode("embedding").alias("bucket", "v")
    )
    weight = F.round(F.col("v").cast("double"), 5).alias("weight")
    return vectors.where("v <> 0").select("doc_id", F.col("bucket").cast("long").alias("bucket"), weight)


DISTANCE = "round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9)"


@query(f"""SELECT b.vec_id AS chunk_id, round({DISTANCE}, 6) + 0.0 AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0
ORDER BY {DISTANCE}, b.vec_id LIMIT 17""")
def knn(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    question = vectors.where("chunk_id = 0").first()["embedding"]
    return search(vectors, question, 17).select("chunk_id", F.round("score", 6).alias("score"))


KNN_SQL = f"""SELECT * FROM (SELECT a.vec_id AS request_id, b.vec_id AS chunk_id, {DISTANCE} AS d,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY {DISTANCE}, b.vec_id) AS rank FROM embeddings a, embeddings b) WHERE rank <= 10"""


def _neighbours(spark, sf_dir, k):
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search_batch(
        vectors.withColumnRenamed("vec_id", "chunk_id"), vectors.withColumnRenamed("vec_id", "request_id"), k
    )


@query(f"SELECT request_id, chunk_id, rank, round(d, 6) + 0.0 AS score FROM ({KNN_SQL})")
def knn_batch(spark, sf_dir):
    return _neighbours(spark, sf_dir, 10).select("request_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"SELECT request_id, rank, 'label ' || label AS logs, round(d, 6) + 0.0 AS score FROM ({KNN_SQL}) JOIN embeddings ON vec_id = chunk_id")
def vector_response(spark, sf_dir):
    labels = read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("text")
    )
    answers = hits_json(_neighbours(spark, sf_dir, 10).join(labels, "chunk_id"), ["request_id"])
    listed = F.from_json("response", "ARRAY<STRUCT<logs: STRING, score: DOUBLE>>")
    return answers.select("request_id", F.posexplode(listed).alias("n", "hit")).select(
        "request_id",
        (F.col("n") + 1).cast("long").alias("rank"),
        F.col("hit.logs").alias("logs"),
        F.round("hit.score", 6).alias("score"),
    )


@query(f"WITH {REQUESTS_SQL} SELECT request_id, CAST(floor(max_tokens * 4 / 800) AS BIGINT) AS k FROM req")
def knn_budget(spark, sf_dir):
    k = F.floor(F.col("max_tokens") * 4 / 800).cast("long")
    return requests(spark, sf_dir).select("request_id", k.alias("k"))


# --- index and the whole filter -------------------------------------------------------------------


def vector_config(**settings) -> VectorFilterConfig:
    given = {
        "log_file_path": "events",
        "issue_description": "purchase by u149 fails with error",
        "start_date": START,
        "end_date": END,
        **settings,
    }
    return VectorFilterConfig(**given)


EVENT_CHUNKS = f"{EVENTS_SQL}, {KEPT}, {chunks_sql('kept')}"


@query(f"WITH {EVENT_CHUNKS} SELECT chunk_id, start_index, text, 1.0 AS norm FROM chunks")
def index_roundtrip(spark, sf_dir):
    cfg = vector_config()
    path = new_table_path(spark, "index")
    signature = signature_of(cfg.log_file_path, cfg.start_date, cfg.end_date)
    write_index(build_index(event_lines(spark, sf_dir), cfg), path, signature, log_file_path=cfg.log_file_path)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return read_index(spark, path, signature).select(
        "chunk_id", "start_index", "text", F.round(F.sqrt(squares), 6).alias("norm")
    )


@query(f"""WITH {REQUESTS_SQL} SELECT md5(log_file_path || chr(31) || coalesce(start_date, '') || chr(31) || coalesce(end_date, '')) AS signature,
  count(*) AS n_requests FROM req GROUP BY ALL""")
def index_reuse(spark, sf_dir):
    signature = signature_column(F.col("log_file_path"), F.col("start_date"), F.col("end_date"))
    return requests(spark, sf_dir).groupBy(signature.alias("signature")).agg(F.count(F.lit(1)).alias("n_requests"))


def nearest_sql(by: str = "") -> str:
    """Hits of question vectors qv(request_id, bucket, v) among chunk vectors cv(chunk_id, bucket, v)."""
    using = f"({by}, bucket)" if by else "(bucket)"
    pair = f"qn JOIN cn USING ({by})" if by else "qn CROSS JOIN cn"
    keys = f"{by}, " if by else ""
    return f"""qn AS (SELECT {keys}request_id, sqrt(sum(CAST(v AS DOUBLE) * v)) AS n FROM qv GROUP BY ALL),
  cn AS (SELECT {keys}chunk_id, sqrt(sum(CAST(v AS DOUBLE) * v)) AS m FROM cv GROUP BY ALL),
  dots AS (SELECT request_id, {keys}chunk_id, sum(CAST(qv.v AS DOUBLE) * cv.v) AS dot FROM qv JOIN cv USING {using} GROUP BY ALL),
  near AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY d, chunk_id) AS rank FROM
    (SELECT request_id, {keys}chunk_id, round(1 - coalesce(dot, 0) / (n * m), 9) AS d FROM {pair} LEFT JOIN dots USING (request_id, {keys}chunk_id)))"""


VECTOR_FILTER_SQL = f"""WITH {EVENT_CHUNKS}, ask AS (SELECT 0 AS request_id, 'purchase by u149 fails with error' AS text),
  {vectors_sql('qv', 'ask', 'request_id')}, {vectors_sql('cv', 'chunks', 'chunk_id')}, {nearest_sql()}
SELECT chunk_id, rank, round(d, 6) + 0.0 AS score, text FROM near JOIN chunks USING (chunk_id) WHERE rank <= 17"""


@query(VECTOR_FILTER_SQL)
def vector_filter_events(spark, sf_dir):
    hits = vector_filter(event_lines(spark, sf_dir), vector_config(), new_table_path(spark, "index"))
    return hits.select("chunk_id", "rank", F.round("score", 6).alias("score"), "text")


@query(VECTOR_FILTER_SQL)
def index_changed_log(spark, sf_dir):
    """An index of the first half of the log, asked again after the rest was appended."""
    lines, path = event_lines(spark, sf_dir), new_table_path(spark, "index")
    half = lines.count() // 2
    vector_filter(lines.where(F.col("pos") < half), vector_config(), path)
    hits = vector_filter(lines, vector_config(), path)
    return hits.select("chunk_id", "rank", F.round("score", 6).alias("score"), "text")


BAD_DATES = "end_date = '2024/01/20'"
VIEWS_SQL = f"""{USERS_SQL.replace('src AS', 'logs AS', 1)}, {REQUESTS_SQL},
  vreq AS (SELECT *, log_file_path || coalesce(start_date, '') || '|' || coalesce(end_date, '') AS view FROM req WHERE filter_mode = 'vector'),
  src AS (SELECT DISTINCT view, pos, line, CASE WHEN {BAD_DATES} THEN NULL ELSE TRY_CAST(start_date AS TIMESTAMP) END AS low,
      CASE WHEN {BAD_DATES} THEN NULL ELSE TRY_CAST(end_date || ' 23:59:59' AS TIMESTAMP) END AS high
    FROM logs JOIN vreq ON file = log_file_path),
  {q.kept_sql("coalesce(low, TIMESTAMP '1900-01-01')", "coalesce(high, TIMESTAMP '2900-01-01')", "view")}, {chunks_sql('kept', 'view')},
  {vectors_sql('qv', 'vreq', 'view, request_id', 'issue_description')}, {vectors_sql('cv', 'chunks', 'view, chunk_id')}, {nearest_sql('view')},
  vhits AS (SELECT request_id, chunk_id, rank, d, chunks.text FROM near JOIN vreq USING (request_id, view) JOIN chunks USING (view, chunk_id)
    WHERE rank <= CAST(floor(max_tokens * 4 / 800) AS BIGINT))"""


@query(f"WITH {VIEWS_SQL} SELECT request_id, chunk_id, rank, round(d, 6) + 0.0 AS score, text FROM vhits")
def vector_filter_requests(spark, sf_dir):
    asked = requests(spark, sf_dir).where("filter_mode = 'vector'")
    hits = vector_filter_batch(asked, user_lines(spark, sf_dir))
    return hits.select("request_id", "chunk_id", "rank", F.round("score", 6).alias("score"), "text")


@query(f"""WITH {VIEWS_SQL} SELECT request_id, count(rank) AS n_hits FROM vreq LEFT JOIN vhits USING (request_id) GROUP BY ALL""")
def vector_responses_requests(spark, sf_dir):
    asked = requests(spark, sf_dir).where("filter_mode = 'vector'")
    answers = vector_responses(asked, vector_filter_batch(asked, user_lines(spark, sf_dir)))
    listed = F.from_json("response", "ARRAY<STRUCT<logs: STRING, score: DOUBLE>>")
    return answers.select("request_id", F.size(listed).cast("long").alias("n_hits"))
