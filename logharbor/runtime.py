"""Shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side may hold at most this many narrow rows.
BROADCAST_ROWS = 1_000_000

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local master without the setting gets a temporary folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = _local_roots.get(sc.applicationId)
        if root is None:
            root = _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="logharbor-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a new, unused folder below the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read on from there."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """The rows written once and counted; hinted as broadcast only if few.

    Returns the frame and whether it is small. Beyond the limit the caller
    gets a plain frame and spreads the join itself if keys may be hot.
    """
    written = cut_lineage(df)
    few = written.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(written) if few else written), few


def join_spread(big: DataFrame, small: DataFrame, keys: list[str], spread_by: str, few: bool,
                how: str = "inner", salts: int = 64) -> DataFrame:
    """Equi-join to a lookup side with unique keys, safe for hot keys.

    A small lookup is broadcast. A large one is copied ``salts`` times and each
    row of the big side picks one copy, so one key spreads over many tasks.
    """
    if few:
        return big.join(small, keys, how)
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def ship_package() -> None:
    """Send this package's functions to executors by value.

    Executors, and the processes that plan streams, then need not have the
    package installed. Importing a module with such functions calls this.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
