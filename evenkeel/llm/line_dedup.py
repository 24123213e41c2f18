"""Line deduplication with levelled sorted runs of line hashes.

The index of the lines seen so far is a set of *runs*: bucketed, sorted Parquet tables of
(128-bit line hash, owner). A batch of new documents is reduced to its distinct hashes, merge-anti-
joined with every run, and what is left becomes a new run of level 0. When a level has ``fanout``
runs they are merged, bucket by bucket and without an exchange, into one run of the next level, so
there are logarithmically many runs.

All work is DataFrame functions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, drop_path, drop_table, id_order, materialize, named_back, new_path, own_columns, renamed, row_key, strip_space, text_of

MIN_KEY_CHARS = 10
#: Lines of a batch for each bucket of a run, so for each task that merges.
BUCKET_LINES = 10_000


class LineRuns:
    """Levelled runs of line hashes. Owners in one run never occur in another.

    ``buckets`` is fixed when the store is made; it is the number of partitions of every merge, and
    defaults to ``spark.sql.shuffle.partitions`` so that a merge shuffles the new batch only.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, fanout: int = 2):
        if fanout < 2:
            raise ValueError("fanout is 2 at least")
        self.spark, self.path, self.fanout = spark, path or new_path(spark, "line-runs"), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unseen(self, owners: DataFrame) -> DataFrame:
        """The rows of ``owners`` (h1, h2, owner; distinct hashes) whose hash is in no run."""
        for run in self.runs():
            owners = owners.join(run, ["h1", "h2"], "left_anti")
        return owners

    def _write(self, owners: DataFrame, level: int) -> None:
        """Writes a run. ``owners`` is partitioned by its hashes already, into as many parts as there are buckets."""
        name = f"line_run_{uuid.uuid4().hex}"
        owners.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.path}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def add(self, owners: DataFrame) -> None:
        """Adds hashes that are in no run yet, then compacts full levels."""
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            owners = owners.repartition(self.buckets, "h1", "h2")
        self._write(owners.select("h1", "h2", "owner"), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            self._write(self.merged(old), level + 1)
            self.levels[level] = []
            for name in old:
                self._drop(name)
            level += 1

    def merged(self, names: list[str]) -> DataFrame:
        """The runs as one. They share no hash, so grouping only brings equal buckets together in one task."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.union(self.spark.table(name))
        return out.groupBy("h1", "h2").agg(F.min("owner").alias("owner"))

    def owners(self) -> DataFrame:
        """Every hash with its owner."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, owner long")
        out = runs[0]
        for run in runs[1:]:
            out = out.union(run)
        return out

    def close(self) -> None:
        """Drops all runs; what was read from them can't be read again."""
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = []

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(self.spark, f"{self.path}/{name}")


def line_keys(text: Column) -> Column:
    """The array of the keys of a text's lines: stripped, with A-Z lower-cased."""
    return F.split(ascii_lower(text), "\n")


def line_hashes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """One row for each line long enough: owner (the id's order), row (key of the row), pos, h1, h2."""
    text = text_of(text_column)
    lines = docs.select(id_order(id_column).alias("owner"), row_key(id_column, text).alias("row"), F.posexplode(line_keys(text)).alias("pos", "line"))
    key = strip_space(F.col("line"))
    return lines.select("owner", "row", "pos", key.alias("key")).where(F.char_length("key") >= min_chars).select("owner", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def _least_owners(lines: DataFrame) -> DataFrame:
    return lines.groupBy("h1", "h2").agg(F.min("owner").alias("owner"))


def add_batch(runs: LineRuns, lines: DataFrame) -> None:
    """Adds one batch of line hashes. Batches come in ascending order of their ids."""
    runs.add(runs.unseen(_least_owners(lines)))


def _cut_points(lines: DataFrame, batch_lines: int) -> list[int]:
    """Owners at which batches of about ``batch_lines`` lines end. All lines of one owner are in one batch."""
    batches = -(-lines.count() // batch_lines)
    if batches < 2:
        return []
    shares = [i / batches for i in range(1, batches)]
    return sorted(set(lines.agg(F.percentile_approx("owner", shares, 20 * batches).alias("q")).first()["q"]))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_KEY_CHARS, batch_lines: int | None = None, fanout: int = 2, buckets: int | None = None, runs: LineRuns | None = None) -> DataFrame:
    """Drops the lines of ``docs`` that a document with a smaller id holds too.

    Adds to the columns of ``docs``: ``n_lines long`` (before dropping), ``n_dropped long`` and
    ``kept_text string``; columns of these names are replaced. A line's key is the line stripped of
    ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; keys under ``min_chars`` code points never drop.
    All lines of a document that owns their key stay, repeats included.

    The documents go through the runs in batches of ascending ids. A batch has about ``batch_lines``
    lines, ``BUCKET_LINES`` for each bucket unless given, so their number follows from the data and a
    merge task stays as small however many there are. Every batch reads all runs: where one call
    brings in very many lines, larger batches read less. With ``runs`` of earlier calls, their lines
    count as seen, and the new ones are kept in them; else the runs are dropped at the end.

    Null or empty texts are one empty line; of very long texts one row holds the array of all lines
    meanwhile. Rows of one id are one document, and equal rows are
    treated alike. Rows without an id count as one document after all others. Empty tables give
    empty results.
    """
    spark, text, passing = docs.sparkSession, text_of(text_column), runs is None
    runs = runs or LineRuns(spark, buckets=buckets, fanout=fanout)
    lines = materialize(line_hashes(docs, id_column, text_column, min_chars), "line-hashes")
    bounds = [None, *_cut_points(lines, batch_lines or BUCKET_LINES * runs.buckets), None]
    for low, high in zip(bounds, bounds[1:]):
        part = lines
        if low is not None:
            part = part.where(F.col("owner") > low)
        if high is not None:
            part = part.where(F.col("owner") <= high)
        add_batch(runs, part)
    # A line stays if its own document owns its key. The document is part of the join key, so a
    # line that is everywhere is spread over all tasks.
    dropped = lines.join(runs.owners(), ["h1", "h2", "owner"], "left_anti").groupBy("owner", "row").agg(F.sort_array(F.collect_set("pos")).alias("drops"))
    dropped = materialize(dropped, "dropped-lines")
    drop_table(lines)
    if passing:
        runs.close()
    c = own_columns(docs, "owner", "row", "drops", "lines", "kept")
    dropped = dropped.select(F.col("owner").alias(c["owner"]), F.col("row").alias(c["row"]), F.col("drops").alias(c["drops"]))
    joined = docs.withColumns({c["owner"]: id_order(id_column), c["row"]: row_key(id_column, text)}).join(dropped, [c["owner"], c["row"]], "left")
    joined = joined.withColumn(c["lines"], F.split(text, "\n"))
    drops, whole = F.col(c["drops"]), F.col(c["lines"])
    # Between two dropped lines lies one slice of kept ones: linear in the lines.
    between = F.transform(
        F.sequence(F.lit(1), F.size(drops) + 1),
        lambda i: F.slice(
            whole,
            F.when(i == 1, F.lit(1)).otherwise(F.get(drops, i - 2) + 2),
            F.when(i > F.size(drops), F.size(whole)).otherwise(F.get(drops, i - 1)) - F.when(i == 1, F.lit(0)).otherwise(F.get(drops, i - 2) + 1),
        ),
    )
    out = joined.withColumns({
        c["kept"]: F.when(drops.isNull(), text).otherwise(F.array_join(F.flatten(between), "\n")),
        "n_lines": F.size(whole).cast("long"),
        "n_dropped": F.when(drops.isNull(), F.lit(0)).otherwise(F.size(drops)).cast("long"),
    })
    return out.withColumn("kept_text", F.col(c["kept"])).drop(*c.values())


def cut_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """The documents with what ``dedup_lines`` leaves of their texts; all other columns as they are, whatever their names."""
    plain, own = renamed(docs)
    cut = dedup_lines(plain, own[id_column], own[text_column], **settings).withColumn(own[text_column], F.col("kept_text"))
    return named_back(cut, own)
