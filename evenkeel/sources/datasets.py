"""Data sets on disk: declared configurations, splits written and read one by one, aligned files."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators.numbering import numbered


@dataclass(frozen=True)
class DatasetConfig:
    """A data set's name, its parts and the columns of each part."""

    name: str
    description: str
    parts: dict[str, str]  # part -> schema


#: The data sets and columns that can be read by name.
CONFIGS = {
    "movielens": DatasetConfig("movielens", "ratings of movies with titles, genres and users' features", {
        "ratings": "user_id STRING, movie_id STRING, user_rating FLOAT, timestamp BIGINT",
        "movies": "movie_id STRING, movie_title STRING, movie_genres ARRAY<STRING>",
    }),
    "plays_1k": DatasetConfig("plays_1k", "plays of artists by a thousand listeners", {
        "plays": "user_id STRING, artist_id STRING, artist_name STRING, plays BIGINT",
        "users": "user_id STRING, user_gender STRING, user_age INT, user_country STRING, user_registration_date STRING",
    }),
    "plays_360k": DatasetConfig("plays_360k", "play counts of listeners and artists", {
        "plays": "user_id STRING, artist_id STRING, artist_name STRING, plays BIGINT",
        "users": "user_id STRING, user_gender STRING, user_age INT, user_country STRING, user_registration_date STRING",
    }),
}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files, in the session's checkpoint folder; a temporary one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='evenkeel-')}"
    return f"{base.rstrip('/')}/evenkeel/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, folder: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def splits_of(spark: SparkSession, folder: str) -> list[str]:
    """The names of the splits of a data set, none if there is no such folder."""
    files, place = _files(spark, folder)
    if not files.exists(place):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(place) if s.isDirectory() and not s.getPath().getName().startswith(("_", ".")))


def write_dataset(rows: DataFrame, folder: str, split: str, overwrite: bool | str = False) -> None:
    """Writes one split beside those that are there.

    A split that exists raises an error; with ``overwrite=True`` it is replaced; with "all" every
    split of the folder goes first.
    """
    if overwrite not in (False, True, "all"):
        raise ValueError("overwrite is False, True or 'all'")
    if overwrite == "all":
        files, place = _files(rows.sparkSession, folder)
        files.delete(place, True)
    rows.write.mode("overwrite" if overwrite is True else "errorifexists").parquet(f"{folder}/{split}")


def load_dataset(spark: SparkSession, folder: str, split: str | None = None, columns: list[str] | None = None, size: int | None = None, tag: str | None = None) -> DataFrame:
    """Reads a split, or all of them in one table with the split's name in ``tag``.

    ``columns`` are all that is read of the files; ``size`` keeps so many rows, for trials.
    """
    there = splits_of(spark, folder)
    wanted = there if split is None else [split]
    if not wanted or not set(wanted) <= set(there):
        raise FileNotFoundError(f"{folder} has the splits {there}")
    out = None
    for name in wanted:
        rows = spark.read.parquet(f"{folder}/{name}")
        rows = rows.select(*columns) if columns else rows
        rows = rows.withColumn(tag, F.lit(name)) if tag else rows
        out = rows if out is None else out.unionByName(rows)
    return out if size is None else out.limit(size)


#: Letters of a compact column description, as statistics packages have them.
TYPES = {"i": "INT", "d": "DOUBLE", "c": "STRING", "l": "BOOLEAN", "D": "DATE", "T": "TIMESTAMP"}


def read_typed(spark: SparkSession, path: str, names: list[str], types: str, sep: str = "\t", header: bool = True, na: str = "NA") -> DataFrame:
    """Delimited text by a letter a column (``TYPES``); ``_`` and ``-`` skip a column, ``na`` is null."""
    if len(names) != len(types):
        raise ValueError("a letter for each column")
    schema = ", ".join(f"`{n}` {TYPES.get(t, 'STRING')}" for n, t in zip(names, types))
    rows = spark.read.csv(path, sep=sep, header=header, schema=schema, nullValue=na)
    return rows.select(*[n for n, t in zip(names, types) if t not in "_-"])


def in_file_order(rows: DataFrame, output: str = "line") -> DataFrame:
    """Numbers the rows of a table just read from files from 0, by file name and place in the file."""
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    return numbered(placed, ["_file", "_block", "_at"], output).drop("_file", "_block", "_at")


def read_aligned_scores(spark: SparkSession, scores_path: str, rows_path: str) -> DataFrame:
    """Scores, one a line, for the rows (uid, iid, label) of a tab-separated file in the same order: (user_id, item_id, score)."""
    scores = in_file_order(spark.read.csv(scores_path, schema="score DOUBLE"))
    rows = in_file_order(spark.read.csv(rows_path, sep="\t", header=True, schema="uid BIGINT, iid BIGINT, label INT"))
    return rows.join(scores, "line").select(F.col("uid").alias("user_id"), F.col("iid").alias("item_id"), "score")


def mapped_predictions(predictions: DataFrame, user_map: DataFrame, item_map: DataFrame) -> DataFrame:
    """Predictions (user, item, score) under inner ids, with the outer ids of two maps (outer, inner); unknown ids are left out."""
    users = user_map.select(F.col("inner").alias("user"), F.col("outer").alias("user_id"))
    items = item_map.select(F.col("inner").alias("item"), F.col("outer").alias("item_id"))
    return predictions.join(users, "user").join(items, "item").select("user_id", "item_id", "score")


def read_labelled_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tab-separated tables ``train``, ``val`` and ``test`` (uid, iid, label), and ``user`` and ``item`` where they are."""
    there = splits_of(spark, folder)
    tables = {n: spark.read.csv(f"{folder}/{n}", sep="\t", header=True, schema="uid BIGINT, iid BIGINT, label INT") for n in ("train", "val", "test") if n in there}
    return tables | {n: spark.read.csv(f"{folder}/{n}", sep="\t", header=True, inferSchema=True) for n in ("user", "item") if n in there}


def with_variables(rows: DataFrame, variables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their logic variable (uid, iid, variable; null where there is none), and one row: the number of variables, largest id + 1."""
    joined = rows.join(variables, ["uid", "iid"], "left")
    return joined, variables.agg((F.coalesce(F.max("variable"), F.lit(-1)) + 1).alias("n_variables"))
