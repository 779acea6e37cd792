"""Session helpers shared by every operator: where to write, how to cut lineage, when to broadcast."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few narrow columns may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Rows of an Arrow batch, unless the session says otherwise: texts are long, and a batch is in memory several times over.
BATCH_ROWS, _UNSET = "2000", "10000"


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and make sure that there is a checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used; only where it is unset (tests) a temporary one is made.
    """
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", _UNSET) == _UNSET:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="grainmill-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files (they survive lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_round(df: DataFrame) -> DataFrame:
    """``cut`` for loops: the files are gone on from without the size that the plan was estimated at.

    Spark hands that size on to what is made of a checkpoint, and estimates a join at the product of its sides: a number of twice the digits each round, in every node of the driver's plans.
    """
    spark, held = df.sparkSession, cut(df)
    rows = held._jdf.queryExecution().toRdd()
    return type(held)(spark._jsparkSession.internalCreateDataFrame(rows, held._jdf.schema(), False), spark)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is (the join then shuffles).

    ``df`` should be cheap to count: a checkpoint or a narrow scan.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
