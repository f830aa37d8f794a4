"""Loop helper for iterative DataFrame algorithms."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

_LOCAL: str | None = None


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one where
    that is unset and all run in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, _LOCAL, True)
    return f"file://{_LOCAL}"


def settle(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends here,
    and executors can be lost afterwards without recomputing it.  All tables of
    an application lie below one folder, which can go when it has ended.  Few
    ``rows_per_file`` spread large rows over the tasks that read them."""
    app = df.sparkSession.sparkContext.applicationId
    path = f"{work_dir(df.sparkSession)}/loomgraph-{app}/loop-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(settled: DataFrame) -> None:
    """Deletes the files of a settled table that nothing will read again."""
    spark = settled.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in settled.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(unquote(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
