"""Helpers that the corpus operators share: white space, intermediate tables, positions."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space of every contract: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, shared by driver and executors.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset on a local master, as in
    tests on one machine, a temporary folder is made and set as the checkpoint folder; on a cluster
    the executors wouldn't see it, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            base = f"file://{tempfile.mkdtemp(prefix='evenkeel-')}"
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")  # without a scheme Spark takes it to be on its default file system


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/evenkeel/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Removes every intermediate table made so far. Results not written yet can't be read after it."""
    while _made:
        drop_path(spark, _made.pop())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs at most the tasks it was running.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes an intermediate table of any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder, none if there is no such folder."""
    place, files = _place(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(place) if f.isDirectory()) if files.exists(place) else []


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder; ``target`` must not exist, its parent is made."""
    (a, files), (b, _) = _place(spark, source), _place(spark, target)
    files.mkdirs(b.getParent())
    if files.exists(b) or not files.rename(a, b):
        raise OSError(f"{source} can't take the place of {target}")


def swap_path(spark: SparkSession, source: str, target: str, aside: str) -> None:
    """Puts one folder in the place of another, which is set aside first and removed last."""
    drop_path(spark, aside)
    if _place(spark, target)[1].exists(_place(spark, target)[0]):
        move_path(spark, target, aside)
    move_path(spark, source, target)
    drop_path(spark, aside)


def drop_table(df: DataFrame) -> None:
    """Removes a table that ``materialize`` wrote and that nothing reads any more."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    work = os.path.realpath(tempfile.mkdtemp(prefix="evenkeel-"))
    atexit.register(shutil.rmtree, work, ignore_errors=True)
    stage = os.path.join(work, "stage")
    shutil.copytree(root, os.path.join(stage, os.path.basename(root)), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(work, f"evenkeel_{uuid.uuid4().hex[:8]}"), "zip", stage))
    _shipped.add(app)


def text_of(column: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Texts of ASCII alone take the faster built-in way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text that isn't null, as an array."""
    inner = strip_space(text)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN))


def row_key(id_column: str, text: Column) -> Column:
    """A key of a row: equal rows share it, rows of one id with other texts do not."""
    return F.xxhash64(F.col(id_column), text)


def id_order(id_column: str) -> Column:
    """Orders ids ascending with null after every other id."""
    return F.coalesce(F.col(id_column).cast("long"), F.lit(9223372036854775807))


def own_columns(df: DataFrame, *wanted: str, prefix: str = "_") -> dict[str, str]:
    """Names for helper columns that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    names = {}
    for w in wanted:
        name = f"{prefix}{w}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names[w] = name
    return names


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under names that no operator uses, and the new name of each column."""
    names = {c: f"_column_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def named_back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(new).alias(old) for old, new in names.items()])


def dense_rank_positions(df: DataFrame, order: list[Column], name: str, position: str) -> DataFrame:
    """Numbers the rows of ``df`` from 0 in ``order`` without gathering them in one task.

    Rows are range-partitioned and sorted; each partition's rows are numbered in place and the
    counts of the partitions before it (one row a partition) are added.
    """
    spark = df.sparkSession
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(
        ordered.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), name
    )
    counts = sorted((r["_part"], r["n"]) for r in numbered.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    starts = spark.createDataFrame(offsets, "_part int, _start long")
    return numbered.join(F.broadcast(starts), "_part").withColumn(position, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")


def positions_within(df: DataFrame, group: list[str], order: list[Column], position: str, name: str) -> DataFrame:
    """Numbers the rows of each group from 1 in ``order``, however many rows one group has.

    All rows are range-partitioned by group and order and sorted, rows that tie in the order they
    are read, so a large group lies in many partitions. Each partition counts the rows that it has
    of a group; a row's number is its place among them and the counts of the partitions before.
    """
    keys = [F.col(g) for g in group]
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    order = [*keys, *order, F.col("_tie")]
    ordered = spread.repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialize(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_row", row).drop("_tie"), name)
    held = placed.groupBy(*group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(*group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return placed.join(starts, [*group, "_part"]).withColumn(position, F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")
