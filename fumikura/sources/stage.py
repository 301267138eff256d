"""Written intermediate tables.

A stage is a Parquet table in the folder that ``spark.checkpoint.dir`` names (shared by all executors on a
cluster), so later reads survive the loss of any executor and the lineage ends there.  Where the setting is unset,
as in tests, a temporary folder of the local machine is used and set for the session.

Stages written inside ``with owned():`` are removed at its end, when the result made from them has been written;
others when the session's Python process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
_KEPT: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        d = "file://" + tempfile.mkdtemp(prefix="fumikura-")
        spark.conf.set("spark.checkpoint.dir", d)
        _KEPT.append((spark, d))
    return d.rstrip("/")


def stage(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Write ``df`` once, with the options of the writer, and return the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(spark: SparkSession, *paths: str) -> None:
    """Paths to remove at the end of the process, not of an owner."""
    _KEPT.extend((spark, p) for p in paths)


@contextlib.contextmanager
def owned() -> Iterator[None]:
    """The stages written inside belong to this block: write or collect the results in it."""
    first = len(_WRITTEN)
    try:
        yield
    finally:
        _remove(_WRITTEN, first)


def _remove(written: list[tuple[SparkSession, str]], first: int = 0) -> None:
    while len(written) > first:
        spark, path = written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


@atexit.register
def _clean() -> None:
    _remove(_WRITTEN)
    _remove(_KEPT)
