"""Shared helpers: the cluster's shared folder, written intermediate tables, text constants."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the text contracts: [\x20\x09-\x0D].
WHITE_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Prefix of internal columns, so that no input column clashes with one.
OWN = "_ll_"
#: monotonically_increasing_id() has the partition above this many bits, the row below.
ROW_BITS = 33
#: Keys that are broadcast at most to leave rows out; beyond that rows meet them in a shuffle.
BROADCAST_ROWS = 1 << 18

_own_folder: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir.

    Only a session on one machine may lack that setting (as tests do) and gets a folder of its own. On a cluster each
    executor would write to its own disk, so there it is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="lotloom-")
    return _own_folder[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses; removed when the program ends."""
    if not _written:
        atexit.register(_remove_all)
    path = f"{shared_folder(spark)}/lotloom-{uuid.uuid4().hex}/{name}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path.rsplit("/", 1)[0])
        except Exception:  # noqa: BLE001  the session may have ended before
            return


class Table:
    """A written intermediate table: lineage ends here, and a lost executor costs only its running tasks."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read from there."""
    return Table(df, name).df


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Texts can be long: unless the session says otherwise, Arrow batches hold 1000 rows, not 10,000."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def give_back() -> None:
    """Python workers outlive their tasks: what a task has freed goes back to the system, as far as the platform can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def rows_without(df: DataFrame, keyed: Callable[[DataFrame], DataFrame], keys: list[str], found: DataFrame, kept: str) -> DataFrame:
    """The rows of df that are kept, without having numbered or copied them.

    keyed adds the key columns to df. found has a row for each row of df with its keys and whether it is kept; of
    rows with the same keys at most one is. Where such a row repeats others, the one that stays is the first by its
    columns as JSON. Rows that go are named by their keys, so few of them are broadcast and texts are not shuffled.
    """
    names = df.columns
    same = [F.col(f"{OWN}gone{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    gone = found.where(~F.col(kept)).select(*[F.col(k).alias(f"{OWN}gone{i}") for i, k in enumerate(keys)]).distinct()
    gone = written(gone, "gone")
    few = gone.count() <= BROADCAST_ROWS
    all_ = keyed(df)
    stay = all_.join(F.broadcast(gone) if few else gone, same, "left_anti").select(*[F.col(quoted(c)) for c in names])
    repeated = written(found.where(kept).select(*keys).join(gone, same, "left_semi"), "repeated")
    if repeated.isEmpty():
        return stay
    repeated = repeated.select(*[F.col(k).alias(f"{OWN}gone{i}") for i, k in enumerate(keys)])
    row = F.struct(*[F.col(quoted(c)) for c in names])
    one = all_.join(repeated, same, "left_semi").groupBy(*keys).agg(F.min_by(row, F.to_json(row)).alias(f"{OWN}one"))
    return stay.unionByName(one.select(*[F.col(f"{OWN}one").getField(c).alias(c) for c in names]))
