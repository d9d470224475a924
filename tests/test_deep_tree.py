"""Nodes are found however deep they lie."""

from pyspark.sql import functions as F

from tidemark.operators import tables


def test_deep_tree(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        edges = spark.createDataFrame([(1, i, i - 1) for i in range(1, 71)], "run_id int, node int, parent int").coalesce(1).cache()
        assert sorted(r.node for r in tables.tree_closure(edges, F.col("node") == 1, F.lit(False)).collect()) == list(range(1, 71))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
