"""The queries of this package, each over its whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.llm import chat, clusters, decontaminate, hard_negatives, html_text, licenses, lm_scoring, minmax, packing, quality, simhash, token_store, toxicity
from logtriage.llm.common import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


@query()
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


@query()
def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = token_store.read_store(spark, path)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


_WORDS_10 = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_10} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_10} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, size, item FROM grams JOIN windows USING (size, gram)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query(OP10_SQL)
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.scored(docs.select("doc_id", "text"), toxicity.learn(docs, table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0)
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.cast("int").alias("predicted"))


@query()
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.quality_rules(docs, table(spark, sf_dir, "labels"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return found.select("doc_id", *(F.col("_quality")[name].alias(name) for name in names))


PROBE = r"\### Assistant: </turn> ok"

OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS t, replace(replace(role, '\', '\\'), '<|', '<\|') AS r FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|start|><|message|><|end|>') + length(t) + length(r))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query(OP2_SQL)
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), roles.alias("role"), F.lit(PROBE).alias("text"))
    messages = rows.unionByName(probe).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    done = chat.format_conversations(messages)
    turns, loss = chat.read_turns(F.col("formatted")), chat.loss_text(F.col("segments"))
    read = done.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted")
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def _canonical_sql(text: str) -> str:
    lowered = f"translate(regexp_replace(coalesce({text}, ''), '{licenses.COPYRIGHT_LINE}', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    form = f"(' ' || regexp_replace({lowered}, '{licenses.SEPARATORS}', ' ', 'g') || ' ')"
    for other, usual in licenses.SPELLINGS:
        form = f"replace({form}, ' {other} ', ' {usual} ')"
    return f"trim(regexp_replace({form}, ' +', ' ', 'g'))"


_KNOWN_SQL = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.KNOWN)

OP1_SQL = f"""
WITH known AS (
  SELECT sha256(form) AS digest, min(license_id) AS license_id FROM (
    SELECT license_id, {_canonical_sql('text')} AS form FROM (VALUES {_KNOWN_SQL}) AS k(license_id, text)) GROUP BY 1),
d AS (SELECT doc_id, text, {_canonical_sql('text')} AS form FROM documents),
notices AS (
  SELECT doc_id, list_sort(list(DISTINCT license_id)) AS notices FROM (
    SELECT doc_id, sha256({_canonical_sql('line')}) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) JOIN known USING (digest)
  GROUP BY doc_id)
SELECT d.doc_id, sha256(form) AS digest, length(form) AS canonical_chars, license_id, array_to_string(coalesce(notices, []), ',') AS notices
FROM d LEFT JOIN known ON sha256(form) = known.digest LEFT JOIN notices ON d.doc_id = notices.doc_id
"""


@query(OP1_SQL)
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), licenses.known_licenses(spark))
    return found.withColumn("notices", F.array_join("notices", ","))


@query()
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _op11_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds written out one after the other."""
    steps = [
        """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v AS p FROM kept QUALIFY c < """ + f"{k})"
    ]
    nearest = """a{n} AS MATERIALIZED (
  SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT row, c, list_sum(list_transform(list_zip(v, p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{n}) GROUP BY row)"""
    mean = """c{after} AS MATERIALIZED (
  WITH sums AS (
    SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
      SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{n} JOIN kept USING (row)) GROUP BY c, i),
  means AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS p FROM sums GROUP BY c)
  SELECT c{n}.c, coalesce(means.p, c{n}.p) AS p FROM c{n} LEFT JOIN means ON c{n}.c = means.c)"""
    for n in range(rounds):
        steps += [nearest.format(n=n), mean.format(n=n, after=n + 1)]
    steps.append(nearest.format(n=rounds))
    end = f"""
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(p, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept USING (row) JOIN c{rounds} f ON a.c = f.c"""
    return ",\n".join(steps) + end


@query(_op11_sql())
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda c: c.cast("string")), ","), 256)
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


OP12_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT row, array_to_string(list_slice(w, i, i + 3), ' ') AS s
  FROM (SELECT row, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT row, count(*) AS n FROM shingles GROUP BY row),
met AS (
  SELECT a.row AS a, b.row AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.row < b.row GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM met JOIN sizes x ON x.row = a JOIN sizes y ON y.row = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
sides AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a AS row, a AS other FROM sides UNION SELECT reached.row, b FROM reached JOIN sides ON reached.other = sides.a),
least AS (SELECT reached.row, min(doc_id) AS id FROM reached JOIN words ON words.row = reached.other GROUP BY reached.row)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(id, doc_id) AS component_id, doc_id = coalesce(id, doc_id) AS kept
FROM words LEFT JOIN sizes USING (row) LEFT JOIN least USING (row)
"""


@query(OP12_SQL)
def op12_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS MATERIALIZED (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row AS other, b.vec_id AS other_id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM kept a, kept b WHERE a.vec_id % 100 = 0 AND a.row <> b.row),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other_id)::INTEGER AS rank,
  n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""


@query(OP13_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), anchor=F.col("vec_id") % 100 == 0, label=label)
