"""The folder that driver and executors share, for tables that cut lineage or are read many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a bucket about, where their number is known.
BUCKET_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session gets a temporary one where it is unset; a cluster without it is
    an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def own_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables on the way to a result; `clear` deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def path(self, name: str) -> str:
        self.paths.append(own_path(self.spark, name))
        return self.paths[-1]

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name, self.path(name))

    def replaced(self, df: DataFrame, name: str) -> DataFrame:
        """As `written`, and the tables before it, which it no longer needs, are deleted."""
        old, self.paths = self.paths, []
        out = self.written(df, name)
        for path in old:
            discard(self.spark, path)
        return out

    def last(self, df: DataFrame, name: str) -> DataFrame:
        """The result as a table that stays, without those on the way to it."""
        out = written(df, name)
        self.clear()
        return out

    def clear(self) -> None:
        while self.paths:
            discard(self.spark, self.paths.pop())


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder."""
    path = path or own_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, name: str, rows: int = 0) -> DataFrame:
    """`df` as a table of buckets in the shared folder: joins, groups and windows by that column need no shuffle. The name in
    the catalog is given up at once; the files stay as those of `written` do. rows: of `df`, if known; a bucket holds
    `BUCKET_ROWS` of them about, at most."""
    spark, path = df.sparkSession, own_path(df.sparkSession, name)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
    title = path.rpartition("/")[2].replace("-", "_")
    df.repartition(buckets, by).write.bucketBy(buckets, by).option("path", path).saveAsTable(title)
    try:
        return spark.table(title)
    finally:
        spark.sql(f"DROP TABLE {title}")  # of a table with a path of its own, only the name


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` as rows in the shared folder, which Spark deletes with the last use where its cleaner may."""
    folder = shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table's commit mark is there."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of `own_path`, and nothing else."""
    if not path.startswith(f"{shared_dir(spark)}/tidemark/"):
        raise ValueError(f"not one of the engine's own folders: {path}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
