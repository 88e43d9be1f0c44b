"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: what the cluster names; a temporary one only in local mode, where one machine has all executors."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="folium-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_clear(df: DataFrame) -> DataFrame:
    """Like cut, and the shuffle files that led to it are deleted before it returns."""
    own = df.select("*")  # a plan of its own: its shuffle files serve nothing else
    written = cut(own)
    release(own)
    return written


def release(df: DataFrame) -> None:
    """Delete the shuffle files of df's plan by their ids, whoever still refers to them; df has run and runs no more.

    Else they stay until the driver collects garbage, at the earliest when Python let go of the plan, up to a second late.
    """
    cleaner = df.sparkSession.sparkContext._jsc.sc().cleaner()
    if cleaner.isDefined():
        for shuffle in shuffles(df._jdf.queryExecution().executedPlan()):
            cleaner.get().doCleanupShuffle(shuffle, True)


def shuffles(plan) -> list[int]:
    """The ids of the shuffles of a physical plan that has run."""
    kind, below = plan.getClass().getSimpleName(), plan.children()
    if kind == "AdaptiveSparkPlanExec":
        return list(plan.context().shuffleIds())
    own = [plan.shuffleDependency().shuffleId()] if kind == "ShuffleExchangeExec" else []
    return own + [k for i in range(below.size()) for k in shuffles(below.apply(i))]


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Like cut, but as a columnar table, with its path: for data that is read more than once by some of its columns."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored_clear(df: DataFrame) -> tuple[DataFrame, str]:
    """Like stored, and the shuffle files that led to it are deleted before it returns.

    They are those that came up meanwhile, as a writing plan can't be asked for its
    own. Where other jobs run at the time, all stay until garbage is collected.
    """
    context = df.sparkSession.sparkContext
    sc = context._jsc.sc()
    first = sc.newShuffleId()
    written = stored(df)
    if sc.cleaner().isDefined() and not context.statusTracker().getActiveJobsIds():
        for shuffle in range(first + 1, sc.newShuffleId()):
            sc.cleaner().get().doCleanupShuffle(shuffle, True)
    return written


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a stored table once all that was made of it is written itself."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def attr(name: str) -> Column:
    """One attribute of a template node."""
    return F.col("attrs")[name]


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table whose size is bounded by its nature; refuses to pull more than ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; raise the limit knowingly")
    return rows
