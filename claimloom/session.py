"""Session helpers: table access, shared checkpoint folder, materialised tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the scan stays lazy so that filters and columns are pushed into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master (tests) may go without the setting: it then gets a temporary folder. On a cluster a missing
    setting is an error, because a folder of one machine cannot be read by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can read")
    own = tempfile.mkdtemp(prefix="claimloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


#: Paths that the ``tidied`` call under way has written, and all that are still there.
_record: ContextVar[list[str] | None] = ContextVar("claimloom_record", default=None)
_left: set[str] = set()


def reserve(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted like the tables of ``materialise``."""
    path = f"{shared_folder(spark)}/claimloom-{uuid.uuid4().hex[:12]}-{label}"
    if not _left:
        atexit.register(_sweep)
    _left.add(path)
    if (record := _record.get()) is not None:
        record.append(path)
    return path


def materialise(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table into the shared folder and read it back: the lineage ends there.

    The files outlive lost executors. Returns the new frame and its path, for ``discard``; what is not discarded is
    deleted when the driver ends.
    """
    spark = df.sparkSession
    path = reserve(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``materialise`` that no frame still in use reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _left.discard(path)


def _sweep() -> None:
    """Delete what is left, as far as it can still be reached."""
    spark = SparkSession.getActiveSession()
    for path in sorted(_left):
        try:
            shutil.rmtree(path.removeprefix("file://")) if path.startswith("file:") else spark and discard(spark, path)
        except Exception:  # noqa: BLE001, S112
            continue


def tidied(make: Callable) -> Callable:
    """A function that returns a frame (or a tuple of frames), with its results written and all its other tables deleted.

    Inside another such call it does nothing: the outer one tidies up. A call that fails leaves no table behind either.
    """

    @wraps(make)
    def run(*args, **kwargs):
        if _record.get() is not None:
            return make(*args, **kwargs)
        token = _record.set(written := [])
        kept: list[str] = []
        spark = None
        try:
            made = make(*args, **kwargs)
            frames = made if isinstance(made, tuple) else (made,)
            spark = frames[0].sparkSession
            done = []
            for f in frames:
                frame, path = materialise(f, make.__name__)
                kept.append(path)
                done.append(frame)
            return tuple(done) if isinstance(made, tuple) else done[0]
        finally:
            _record.reset(token)
            spark = spark or SparkSession.getActiveSession()
            for path in written:
                if path not in kept and spark is not None:
                    discard(spark, path)

    return run


def spread(df: DataFrame) -> DataFrame:
    """A scan in at least as many partitions as there are cores, for Python stages that cost more than a shuffle of a
    small input; a scan that has as many already, as any large one does, stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_rows(df: DataFrame, max_rows: int) -> list | None:
    """The rows of a table known to be small, or None when it has more than ``max_rows``.

    At most ``max_rows + 1`` rows ever reach the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


#: Trims every Unicode blank, which plain ``trim`` leaves in place.
def strip_blanks(c):
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
