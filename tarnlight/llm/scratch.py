"""Shared working folder and code shipping for operators that run more than one job."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A Python worker holds few texts at a time: up to 512, of 16 MB together, or one longer text.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is `spark.checkpoint.dir` of the session. Only where that is unset in a local session, as in
    tests, a temporary folder is made and set as the checkpoint folder of this application; elsewhere
    executors would write where the driver can't read, so that is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(sc, "_tarnlight_scratch", None)
        if not base:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = sc._tarnlight_scratch = tempfile.mkdtemp(prefix="tarnlight-")
            sc.setCheckpointDir(base)
    return base.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends at replicated files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarnlight-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarnlight_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote for df, where nothing that is still to run reads it."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(df._tarnlight_path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Have a written folder deleted when the application ends, as lazy results may read it until then."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once for each application, and bound their batches, unless
    the application was started with settings of its own for those."""
    sc = spark.sparkContext
    for name, value in ARROW.items():
        if not sc.getConf().contains(name):
            spark.conf.set(name, value)
    if getattr(sc, "_tarnlight_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tarnlight-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "tarnlight_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(target)
    sc._tarnlight_shipped = True


def spread(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """A table of up to `most` bytes dealt over all cores, as one small file is one task; a larger one as it is."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= most else df


class Salts:
    """Joins on a key of which some values hold very many rows: those get one of `salts` salts on the left side, and the
    right side's row for each of them. counts: (key, n), written already. A value is hot with more than one in `share` of
    the counted rows, so there are fewer than `share` hot values, and those alone are broadcast."""

    def __init__(self, counts: DataFrame, key: str, share: int = 1000, salts: int = 64):
        total = counts.agg(F.sum("n")).scalar()
        self.key, self.salts = key, salts
        self.hot = F.broadcast(counts.where(F.col("n") * share > total).select(key, F.lit(True).alias("__hot")))

    def left(self, df: DataFrame, place: list[str | Column]) -> DataFrame:
        """df with __salt; place: what tells the rows of one value apart."""
        salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*place), F.lit(self.salts))).otherwise(0).cast("int")
        return df.join(self.hot, self.key, "left").withColumn("__salt", salt).drop("__hot")

    def right(self, df: DataFrame) -> DataFrame:
        """df (one row for a value, or few) with __salt, a hot value's rows once for each."""
        each = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(self.salts - 1))).otherwise(F.array(F.lit(0)))
        return df.join(self.hot, self.key, "left").withColumn("__salt", F.explode_outer(each)).drop("__hot")
