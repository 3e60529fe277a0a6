"""Cutting lineage of iterative plans and of results that a plan uses more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where none is set a session on one machine gets a temporary one; on a cluster, whose machines do not see each
    other's folders, it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gridspark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Later steps start from these files, so a lost executor costs no recomputation of earlier ones. Unlike
    ``checkpoint()`` the rows are computed once and stored compressed, by column. Shuffle files of the write go once
    it is done; what it wrote goes when the session's JVM ends, or by ``forget``. ``options`` go to the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gridspark-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def forget(*dfs: DataFrame) -> None:
    """Delete the files that ``cut`` wrote for each of ``dfs``, once all that was made from them is written too."""
    for df in dfs:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.rsplit("/", 1)[-1].startswith("gridspark-"):
                at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
