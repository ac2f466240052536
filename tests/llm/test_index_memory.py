"""The benchmark index keeps its memory bounded, however many shards a task makes."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from logtriage.llm import decontaminate


def test_row_groups_hold_few_shards_and_batches_are_small(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(decontaminate.WRITTEN, "parquet.block.size", 64 * 1024)
    seen, build = [], spark.conf.get(decontaminate.BATCH_SETTING)
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda n: F.hex(F.xxhash64("id", n))), " ")
    docs = spark.range(0, 90, 1, 1).select(F.col("id").alias("doc_id"), words.alias("text"))
    small = decontaminate._small_batches
    monkeypatch.setattr(decontaminate, "_small_batches", lambda s: seen.append(s) or small(s))
    decontaminate.build_index(docs, str(tmp_path / "index"), shard_words=400)
    (file,) = [f for f in (tmp_path / "index").glob("part-*") if pq.ParquetFile(f).metadata.num_rows]
    meta = pq.ParquetFile(file).metadata
    assert meta.num_rows == 90
    assert max(meta.row_group(n).num_rows for n in range(meta.num_row_groups)) <= 10
    assert seen and spark.conf.get(decontaminate.BATCH_SETTING) == build
    items = docs.where("doc_id = 7").select(F.lit("a").alias("item_id"), "text")
    found = decontaminate.judged(decontaminate.find_passages(spark.read.schema(decontaminate.SHARD).parquet(str(tmp_path / "index")), items))
    assert [r["doc_id"] for r in found.where("contaminated").collect()] == [7] and found.count() == 90


def test_a_smaller_limit_of_the_session_stays(spark):
    key, before = decontaminate.BATCH_SETTING, spark.conf.get(decontaminate.BATCH_SETTING)
    try:
        for given, inside in (("1024", "1024b"), ("67108864", f"{decontaminate.BATCH_BYTES}b")):
            spark.conf.set(key, given)
            with decontaminate._small_batches(spark):
                assert spark.conf.get(key).rstrip("b") == inside.rstrip("b")
            assert spark.conf.get(key).rstrip("b") == given
    finally:
        spark.conf.set(key, before)
