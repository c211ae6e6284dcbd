"""Session helpers: reading tables, cutting lineage, size checks."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: How written steps are cut: by size, not by the number of cores.
_FILES = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m"}
_LIVE: set[tuple[int, str]] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, so that they need no path to it."""
    sc = spark.sparkContext
    if getattr(sc, "_tallyforge_shipped", False):
        return
    root = Path(__file__).resolve().parent
    name = os.path.join(tempfile.mkdtemp(prefix="tallyforge-"), f"tallyforge_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(name)  # the driver serves the file to executors, also to those that start later
    sc._tallyforge_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder of its own, which the session's settings do not show; a cluster
    session is refused, because a machine-local folder would not be seen by the other executors.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(sc, "_tallyforge_dir"):
        sc._tallyforge_dir = f"file://{tempfile.mkdtemp(prefix='tallyforge-')}"
    return sc._tallyforge_dir


def materialise(df: DataFrame, name: str = "step", by_size: bool = False, **seen: Column) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: its lineage ends there.

    Unlike ``checkpoint()`` it computes the plan once, keeps columns prunable, and survives the loss of executors. by_size:
    shuffled data are written in files of a fair size, however many tasks there could be, so small steps stay small; for
    plans whose last stage does little but write. seen: aggregates that are taken while it is written, for ``observed``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyforge-{name}-{uuid.uuid4().hex}"
    observation = Observation()
    if seen:
        df = df.observe(observation, *[c.alias(k) for k, c in seen.items()])
    with _conf(spark, _FILES if by_size else {}):
        df.write.parquet(path)
    if not _LIVE:
        atexit.register(_drop_all)
    _LIVE.add((id(spark), path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyforge_path = path  # for release()
    out._tallyforge_seen = observation.get if seen else {}
    return out


def observed(df: DataFrame) -> dict:
    """The aggregates that ``materialise`` took while it wrote a frame."""
    return df._tallyforge_seen


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def release(*frames: DataFrame | None) -> None:
    """Deletes the tables behind frames that ``materialise`` made and that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tallyforge_path", None)
        if path:
            _delete(df.sparkSession, path)
            _LIVE.discard((id(df.sparkSession), path))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that queries write inside the block are deleted at its end; results must have been used by then."""
    before = set(_LIVE)
    try:
        yield
    finally:
        for key in _LIVE - before:
            _delete(spark, key[1])
            _LIVE.discard(key)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_all() -> None:
    spark = SparkSession.getActiveSession()
    for _, path in list(_LIVE):
        try:
            if spark is not None:
                _delete(spark, path)
        except Exception:  # the JVM may be gone already; the folder is the cluster's to empty then
            return
    _LIVE.clear()
