"""Writers of splits and of the input files that other tools expect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_split(rows: DataFrame, folder: str, split: str, overwrite: bool = False) -> None:
    """One split as Parquet; an existing one raises unless it is to be overwritten."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{folder}/{split}")


def write_train_test(train: DataFrame, test: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Both splits; existing ones stay unless they are to be overwritten."""
    mode = "overwrite" if overwrite else "ignore"
    train.write.mode(mode).parquet(f"{folder}/train")
    test.write.mode(mode).parquet(f"{folder}/test")


def write_table(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.mode("overwrite").csv(path, sep=sep, header=True, nullValue="")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def labelled_rows(rows: DataFrame, threshold: float = 3.0, keep: list[str] | None = None) -> DataFrame:
    """uid, iid, label rows, and the columns to ``keep``: label 1 for ratings over the threshold."""
    return rows.select(F.col("user_id").alias("uid"), F.col("item_id").alias("iid"), (F.col("rating") > threshold).cast("int").alias("label"), *(keep or []))


def write_labelled(rows: DataFrame, part: str, names: tuple[str, ...], folder: str) -> None:
    """``labelled_rows`` as tab-separated files in a folder for each value of ``part``; rows are read and written once. Parts without rows get empty files.

    Rows of other parts, or of none, aren't written.
    """
    spark, wanted = rows.sparkSession, rows.where(F.col(part).isin(*names))
    labelled_rows(wanted, keep=[part]).write.partitionBy(part).csv(folder, sep="\t", header=True)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = place(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in names:
        if files.exists(place(f"{folder}/{part}={name}")):
            if not files.rename(place(f"{folder}/{part}={name}"), place(f"{folder}/{name}")):
                raise OSError(f"{folder}/{part}={name} can't be renamed")
        else:
            labelled_rows(spark.createDataFrame([], rows.schema)).write.csv(f"{folder}/{name}", sep="\t", header=True)


def rerank_rows(scores: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """uid, iid, score, label for re-ranking: train items are left out and test items have label 1."""
    fresh = scores.join(train.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    hits = test.select("user_id", "item_id", F.lit(1).alias("label")).distinct()
    return fresh.join(hits, ["user_id", "item_id"], "left").select(F.col("user_id").alias("uid"), F.col("item_id").alias("iid"), "score", F.coalesce("label", F.lit(0)).alias("label"))


def group_rows(ranked: DataFrame, users: DataFrame, sensitive: bool) -> DataFrame:
    """The rows of one group's users."""
    group = users.where(F.col("sensitive") == sensitive).select(F.col("user_id").alias("uid"))
    return ranked.join(group, "uid", "left_semi")


def adjacency(rows: DataFrame, users: bool = True) -> DataFrame:
    """Neighbours of each user (or item) as a sorted array."""
    a, b = ("user_id", "item_id") if users else ("item_id", "user_id")
    return rows.groupBy(F.col(a).alias("node")).agg(F.sort_array(F.collect_set(b)).alias("neighbours"))


def sensitive_rows(rows: DataFrame, users: DataFrame) -> DataFrame:
    """user, item, score, sensitive (1 or 0)."""
    return rows.join(users.select("user_id", "sensitive"), "user_id").select("user_id", "item_id", F.col("rating").alias("score"), F.when(F.col("sensitive"), 1).otherwise(0).alias("sensitive"))


def gendered_rows(rows: DataFrame, users: DataFrame) -> DataFrame:
    """user, item, rating, gender (M or F)."""
    return rows.join(users.select("user_id", "sensitive"), "user_id").select(F.col("user_id").alias("user"), F.col("item_id").alias("item"), "rating", F.when(F.col("sensitive"), "M").otherwise("F").alias("gender"))


def user_features(rows: DataFrame, users: DataFrame) -> DataFrame:
    """One gender for each user that has rows."""
    return rows.join(users, "user_id").groupBy("user_id").agg(F.min(F.when(F.col("sensitive"), "M").otherwise("F")).alias("gender"))


def group_lists(users: DataFrame) -> DataFrame:
    """The sorted user ids of each group."""
    return users.groupBy("sensitive").agg(F.sort_array(F.collect_set("user_id")).alias("users"))


#: Name -> function (train, test, users) of the exported table; enabled names are written.
EXPORTS: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {
    "labelled": lambda train, test, users: labelled_rows(train),
    "adjacency": lambda train, test, users: adjacency(train),
    "sensitive": lambda train, test, users: sensitive_rows(train, users),
    "gendered": lambda train, test, users: gendered_rows(train, users),
    "user_features": lambda train, test, users: user_features(train, users),
}


def export(names: list[str], train: DataFrame, test: DataFrame, users: DataFrame, folder: str) -> None:
    for name in names:
        EXPORTS[name](train, test, users).write.mode("overwrite").parquet(f"{folder}/{name}")
