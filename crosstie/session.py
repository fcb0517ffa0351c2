"""Session-level helpers: shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every node can see, as named by ``spark.checkpoint.dir``.

    Only when a local session names none (tests on one machine) a temporary folder is
    created and recorded in the session for the following calls; a cluster must name one,
    as its nodes do not share temporary folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if master.split("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder shared by all nodes (master {master!r})")
        path = tempfile.mkdtemp(prefix="crosstie-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written once and read back from shared storage."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str, codec: str | None = None, options: dict | None = None) -> DataFrame:
    """Write the rows once under the shared folder and go on from the files.

    Cuts the lineage like a reliable checkpoint, but in the compressed, column-wise form
    of Parquet; lost executors only reread files. ``discard`` deletes the files.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", codec) if codec else df.write
    writer.options(**options or {}).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
