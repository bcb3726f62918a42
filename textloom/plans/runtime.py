"""Where intermediate tables go, and checks of size before anything is broadcast or sent to the driver."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder as ``spark.checkpoint.dir`` names it; in local mode one is set if there is none."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(d)
        return d
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not own.isEmpty():
        return own.get()
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_written: list[tuple[SparkSession, str]] = []


@contextlib.contextmanager
def scratch():
    """``with scratch():`` deletes the tables that were written inside when it ends, so a long session can free them once a result is
    stored."""
    before = len(_written)
    try:
        yield
    finally:
        clear_written(before)


def mark() -> int:
    """How many tables there are so far, for ``clear_written``."""
    return len(_written)


def clear_written(keep: int = 0, last: bool = False) -> None:
    """Deletes the tables that ``written`` has made after the first ``keep``, with ``last`` all but the last one; DataFrames that read
    them can't be used any more. Runs when Python ends."""
    if last and len(_written) > keep:
        _written.insert(keep, _written.pop())
        keep += 1
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone
            return


atexit.register(clear_written)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table written in the shared folder: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """What is written inside leaves no shuffle files: they're deleted when the write has ended, not when the driver happens to collect
    its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def at_most(df: DataFrame, n: int) -> bool:
    """Whether ``df`` has at most ``n`` rows; counts no further than it must."""
    return df.limit(n + 1).agg(F.count(F.lit(1))).first()[0] <= n


#: A table of at most so many narrow rows may be broadcast whole.
SMALL_ROWS = 100_000
HOT_KEYS = 20_000


def lookup(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """Join of many rows with a table that has one row a key, where some keys may be hot on the left.

    ``weight`` is a column of ``right``: at most how many rows of ``left`` have the key. A right side of at most ``SMALL_ROWS`` narrow
    rows is broadcast. Beyond that it's a join by a shuffle, in which a key of more than 1/HOT_KEYS of all rows (there are at most
    HOT_KEYS such) is cut: its left rows are dealt to parts of that size by a hash of the whole row, and its right row has a
    copy for each. Both sides are read once."""
    if at_most(right, SMALL_ROWS):
        return left.join(F.broadcast(right), keys, how)
    total, top = right.agg(F.sum(weight), F.max(weight)).first()
    part = max(1, (total or 0) // HOT_KEYS)
    if (top or 0) <= part:
        return left.join(right, keys, how)
    parts = F.when(F.col(weight) > part, F.ceil(F.col(weight) / part)).otherwise(1).cast("long")
    hot = right.where(F.col(weight) > part).select(*keys, parts.alias("_parts"))
    row = F.xxhash64(*[c.name for c in left.schema if not _has_map(c.dataType)])
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(row, F.coalesce("_parts", F.lit(1).cast("long")))).drop("_parts")
    copies = right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(_has_map(f.dataType) for f in t)
    return isinstance(t, T.MapType) or isinstance(t, T.ArrayType) and _has_map(t.elementType)


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer partitions than the cluster has cores, dealt out over all of them; any larger table as it is. So only
    tables that are small against the cluster are shuffled for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
