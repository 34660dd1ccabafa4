"""What the jobs need of a session: the shared folder, written tables, code on the workers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session has none do we set one: beside the warehouse on a
    cluster, in the temp folder for a local master. On a cluster whose warehouse is
    a local folder too there is none that all executors share, and jobs that need
    one are refused.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and (on := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        there = on.get()
    if not there:
        local = spark.sparkContext.master.split("[")[0] == "local"
        base = f"file://{tempfile.gettempdir()}/checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir")
        if not local and base.startswith(("file:", "/")):
            raise ValueError(f"spark.checkpoint.dir is not set, and the warehouse {base} is a folder of the driver's machine alone")
        there = f"{base.rstrip('/')}/meshtide-{uuid.uuid4().hex}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """A narrow table cut off from its lineage, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a narrow table that one task gets.
TASK_ROWS = 1 << 17


def settled(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """:func:`checkpointed`, read by as few tasks as its rows need, so that the steps of a loop do not leave a file for each empty partition."""
    df = checkpointed(df)
    return df.coalesce(max(1, -(-df.count() // task_rows)))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back (for wide rows)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _tables(spark: SparkSession) -> list[str]:
    """Paths that :func:`written` made in this application."""
    sc = spark.sparkContext
    if not hasattr(sc, "_meshtide_tables"):
        sc._meshtide_tables = []
    return sc._meshtide_tables


def sweep(df: DataFrame) -> None:
    """Deletes the tables that :func:`written` made and ``df`` does not read.

    For a chain of jobs whose results are stored one by one, before each next job.
    """
    spark, needed = df.sparkSession, df.inputFiles()
    for path in list(_tables(spark)):
        name = path.rsplit("/", 1)[1]
        if not any(f"/{name}/" in f for f in needed):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            _tables(spark).remove(path)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark deletes shuffle files only once nothing there refers to them, which a chain of wide jobs should not leave to chance."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, unless they find it themselves."""
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in on_path or (os.getcwd() == str(ROOT) and spark.sparkContext.master.startswith("local[")):
        return
    if getattr(spark.sparkContext, "_meshtide_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "meshtide.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in (ROOT / "meshtide").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._meshtide_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(df: DataFrame) -> tuple:
    """Row count and an order-free hash sum; equal tables have equal digests."""
    h = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    return tuple(df.agg(F.count(F.lit(1)), h).first())
