"""Session plumbing shared by all operators: loading, cutting lineage, size-checked broadcast."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; every call site holds rows of well under 1 KB.
BROADCAST_ROWS = 100_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, unless PYTHONPATH has it."""
    sc, home = spark.sparkContext, Path(__file__).resolve().parent
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(home.parent) in paths or getattr(sc, "_proofmark_shipped", False):
        return
    staging = Path(tempfile.mkdtemp(prefix="proofmark-"))  # on the driver only: Spark copies the archive from here
    shutil.copytree(home, staging / "src" / home.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(staging / home.name), "zip", staging / "src"))
    sc._proofmark_shipped = True


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a table written to the folder all executors share (spark.checkpoint.dir), which
    survives the loss of any of them. Unlike checkpoint() it is computed once, not twice, and is read
    by column. The tables are removed when the driver's Python ends.
    """
    sc = df.sparkSession.sparkContext
    path = f"{shared_folder(sc)}/proofmark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_removed, sc, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(sc: SparkContext) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where the session names none, one is
    made on this machine if all tasks run in this process; on a cluster every executor would write to
    a disk of its own and rows would be lost without an error, so there the call is refused."""
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError(f"spark.checkpoint.dir is not set: name a folder that all executors of {sc.master} share")
    folder = tempfile.mkdtemp(prefix="proofmark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return folder


def _removed(sc: object, path: str) -> None:
    """Best effort: nothing to do where the context has ended already."""
    try:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001
        pass


def release(spark: SparkSession) -> None:
    """Free what finished jobs left on the driver: broadcast tables and shuffle records are given up only
    when the driver's garbage is collected, which a loop of many small jobs may outrun."""
    spark.sparkContext._jvm.System.gc()


def tasks(spark: SparkSession) -> int:
    """Tasks for work that is heavy beside its bytes: two for each core, the shuffle setting at least."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer partitions than there are cores, spread over all of them, for work that is
    heavy beside its bytes; a large scan has partitions enough and stays where it is."""
    if scan.rdd.getNumPartitions() >= scan.sparkSession.sparkContext.defaultParallelism:
        return scan
    return scan.repartition(tasks(scan.sparkSession))


def exploded(df: DataFrame, array: Column, names: list[str]) -> DataFrame:
    """df with one row per item of an array that is costly to make: [item] or [place, item] as the
    named columns. The plain explode would have the optimizer infer a filter on the array's size and
    push it down, which makes the array twice."""
    made = F.posexplode_outer(array).alias(*names) if len(names) == 2 else F.explode_outer(array).alias(names[0])
    return df.select("*", made).where(F.col(names[-1]).isNotNull())


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `rows` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only behind a check of the row count; beyond it a shuffled join runs."""
    return F.broadcast(df) if fits(df, rows) else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value evaluated once: lambda bodies know no common subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim of all Unicode white space at both ends, null kept."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
