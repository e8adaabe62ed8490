"""Tables in the shared folder, which end a plan's lineage and outlive the executors that made them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Only a session on one machine may do without: a cluster's executors
    would each write to a folder of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        where = f"file://{tempfile.gettempdir()}/mnemospark-checkpoints"
    return where.rstrip("/")


def cut(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it again."""
    path = f"{shared_folder(df.sparkSession)}/mnemospark/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the files behind a frame made by ``cut`` once nothing reads them."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
