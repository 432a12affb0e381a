"""Tables between stages are written in small row groups, which bound what tasks hold of them."""

from glob import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark.llm import common


def row_groups(where: str) -> list[int]:
    files = [pq.ParquetFile(f).metadata for f in glob(f"{where}/*.parquet")]
    return [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]


def test_row_groups_of_kept_tables_and_of_stages_are_small(spark, tmp_path):
    docs = spark.range(12_000).select("id", F.expr("array_join(transform(sequence(1, 80), i -> sha2(concat(id, '-', i), 256)), ' ')").alias("text")).coalesce(1)  # 60 MB in one task
    before = spark.conf.get("parquet.block.size", None)
    try:
        spark.conf.unset("parquet.block.size")
        kept = common.Workspace(spark, "groups").keep(docs, "docs")
        assert max(row_groups(kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])) < 2 * common.GROUP_BYTES
        common.small_batches(docs).write.parquet(f"{tmp_path}/stage")  # as a stage's rows are written by its caller
        assert max(row_groups(f"{tmp_path}/stage")) < 2 * common.GROUP_BYTES
        spark.conf.set("parquet.block.size", "1000000")
        common.small_batches(docs)
        assert spark.conf.get("parquet.block.size") == "1000000"
    finally:
        spark.conf.set("parquet.block.size", before) if before else spark.conf.unset("parquet.block.size")
