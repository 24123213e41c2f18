"""Secret scans over an incremental ledger of blobs.

Each version of a text is addressed by its content (SHA-256). The ledger records which blob was
scanned with which version of which rule; a scan reads only blobs with a pair that isn't recorded,
each once however many paths hold it, and findings are joined back to all paths.

The ledger is partitioned by the first hexadecimal digits of the blob: a scan reads and a compaction
rewrites only the prefixes of its own blobs.

All work is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_path, folders, materialize, move_path, new_path, swap_path, text_of


@dataclass(frozen=True)
class SecretRule:
    """A pattern; ``hints`` are strings of which every match, lower-cased, holds one."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0  # characters that the group needs; other matches are dropped
    hints: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: Base kinds first, in the order of the contract, then the kinds that the method adds. A run of
#: hexadecimal digits or key letters that is too short holds no longer one, so the least length
#: stands in the pattern; for assignments it is tested afterwards.
RULES = (
    SecretRule("assign", 1, rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    SecretRule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18, ("akia",)),
    SecretRule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
    SecretRule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, ("private key-----",)),
    # A token begins where a run of its characters does and takes parts whole, so a long unbroken run
    # is read once whatever its length is.
    SecretRule("jwt", 3, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 0, ("eyj",)),
)


#: Rows of a compacted file, on average at most.
FILE_ROWS = 1_000_000
TABLES = {"scanned": "blob binary, rules array<string>", "findings": "blob binary, rule string, start int, `end` int"}


def blob_of(text: Column) -> Column:
    """The content address of a text: its SHA-256, in binary."""
    return F.unhex(F.sha2(text, 256))


def _matches(text: Column, low: Column, rule: SecretRule, place: int, pending: Column) -> Column:
    """For each match the characters before it since the last one, its own, and its group's."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = found if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern)
    rows = F.transform(found, lambda m, i: F.struct(F.lit(place).alias("kind"), i.alias("k"), F.char_length(F.get(gaps, i)).alias("gap"), F.char_length(m).alias("size"), F.char_length(F.get(groups, i)).alias("got")))
    worth = F.array_contains(pending, rule.key)
    hinted = text.rlike(rule.pattern) if not rule.hints else F.lit(False)
    for hint in rule.hints:
        hinted = hinted | low.contains(hint)
    return F.when(worth & hinted, rows).otherwise(F.array().cast("array<struct<kind:int,k:int,gap:int,size:int,got:int>>"))


def scan_blobs(blobs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Findings of ``blobs`` (blob, text, pending array of rule keys; one row a blob).

    Returns ``blob, kind int (the rule's place), start int, end int`` in code points. Per kind,
    matches are the leftmost that do not overlap; those whose group is too short are dropped.
    """
    text, low = F.col("text"), F.col("low")
    ready = blobs.withColumn("low", F.lower(text))
    for place, rule in enumerate(rules):
        ready = ready.withColumn(f"found_{place}", _matches(text, low, rule, place, F.col("pending")))
    rows = ready.select("blob", F.explode(F.flatten(F.array(*[f"found_{p}" for p in range(len(rules))]))).alias("m")).select("blob", "m.*")
    # A match starts after all that lies before it: a running sum over the blob's matches of a kind.
    order = Window.partitionBy("blob", "kind").orderBy("k")
    end = F.sum(F.col("gap") + F.col("size")).over(order)
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("kind") + 1)
    return rows.withColumn("end", end.cast("int")).where(F.col("got") >= least).select("blob", "kind", (F.col("end") - F.col("size")).cast("int").alias("start"), "end")


class BlobLedger:
    """Two tables in one folder: scanned (blob, rules) and findings (blob, rule, start, end).

    Both are partitioned by ``prefix``, the first ``digits`` (0 to 2) hexadecimal digits of the blob.
    Scans append; ``compact`` puts the files of each prefix together.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[SecretRule, ...] = RULES, digits: int = 1):
        if not 0 <= digits <= 2:
            raise ValueError("prefixes have 0 to 2 digits")
        self.spark, self.rules, self.digits = spark, rules, digits
        self.path = path or new_path(spark, "blob-ledger")
        self.recover()
        for table, columns in TABLES.items():
            spark.createDataFrame([], f"{columns}, prefix string").write.mode("append").parquet(f"{self.path}/{table}")

    def _read(self, table: str, prefixes: list[str] | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{TABLES[table]}, prefix string").parquet(f"{self.path}/{table}")
        return rows if prefixes is None else rows.where(F.col("prefix").isin(prefixes))

    def _append(self, rows: DataFrame, table: str) -> None:
        """Appends a file or more to each prefix, as many as there are tasks to write them."""
        share = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 16**self.digits)
        dealt = rows.withColumn("prefix", self.prefix_of(F.col("blob"))).repartition(F.col("prefix"), F.pmod(F.xxhash64("blob"), F.lit(share)))
        dealt.write.mode("append").partitionBy("prefix").parquet(f"{self.path}/{table}")

    def prefix_of(self, blob: Column) -> Column:
        return F.concat(F.lit("p"), F.lower(F.substring(F.hex(blob), 1, self.digits)))

    def scanned(self, prefixes: list[str] | None = None) -> DataFrame:
        return self._read("scanned", prefixes).drop("prefix")

    def findings(self, prefixes: list[str] | None = None) -> DataFrame:
        return self._read("findings", prefixes).drop("prefix")

    def is_empty(self) -> bool:
        return self.scanned().isEmpty()

    def prefixes(self, blobs: DataFrame) -> list[str]:
        """The prefixes of ``blobs`` (blob): 256 at most."""
        return sorted(r[0] for r in blobs.select(self.prefix_of(F.col("blob"))).distinct().collect())

    def scan(self, versions: DataFrame, text_column: str = "text") -> list[str] | None:
        """Scans the blobs of ``versions`` with the rules that haven't read them, and records both.

        Returns the prefixes of the versions' blobs, null if all of them may occur. Findings are
        written before the record of the scan: a scan that breaks off is done again and its findings,
        read as distinct rows, do no harm.
        """
        keys = F.array(*[F.lit(r.key) for r in self.rules])
        text = text_of(text_column)
        addressed = versions.select(blob_of(text).alias("blob"))
        first = self.is_empty()
        within = None if first else self.prefixes(addressed)
        blobs = versions.select(blob_of(text).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
        done = self.scanned(within).groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("done"))
        pending = F.array_except(keys, F.coalesce("done", F.array().cast("array<string>")))
        # Nothing is recorded in a new ledger, so all pairs are unseen without a join.
        fresh = blobs.withColumn("pending", keys) if first else blobs.join(done, "blob", "left").withColumn("pending", pending)
        names = F.array(*[F.lit(r.key) for r in self.rules])
        found = scan_blobs(fresh.where(F.size("pending") > 0).select("blob", "text", "pending"), self.rules)
        self._append(found.select("blob", F.element_at(names, F.col("kind") + 1).alias("rule"), "start", "end"), "findings")
        seen = addressed.distinct()
        seen = seen.withColumn("rules", keys) if first else seen.join(done, "blob", "left").withColumn("rules", pending)
        self._append(seen.where(F.size("rules") > 0).select("blob", "rules"), "scanned")
        return within

    def compact(self, prefixes: list[str] | None = None, file_rows: int = FILE_ROWS) -> None:
        """Puts the files of each prefix (all, or those named) together; repeated findings go.

        All prefixes are written in one job, ``file_rows`` rows to a file at most on average, so no task takes
        a whole prefix. The files land in a folder of their own. A prefix's old folder is renamed
        aside before the new one takes its name, and goes when it has: a driver lost in between
        leaves both, and ``recover``, which every ledger calls when it is opened, puts one in place.
        """
        for table in TABLES:
            rows = self._read(table, prefixes).distinct()
            counts = rows.groupBy("prefix").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
            share = F.pmod(F.xxhash64("blob"), F.lit(-(-counts // file_rows) or 1))
            fresh = f"{self.path}/compacted/{table}"
            rows.repartition(F.col("prefix"), share).write.mode("overwrite").partitionBy("prefix").parquet(fresh)
            for name in folders(self.spark, fresh):
                swap_path(self.spark, f"{fresh}/{name}", f"{self.path}/{table}/{name}", f"{self.path}/replaced/{table}/{name}")

    def recover(self) -> None:
        """Ends what a lost driver left of ``compact``: a folder set aside comes back if none has its name, else it goes."""
        for table in TABLES:
            for name in folders(self.spark, f"{self.path}/replaced/{table}"):
                aside, place = f"{self.path}/replaced/{table}/{name}", f"{self.path}/{table}/{name}"
                if name in folders(self.spark, f"{self.path}/{table}"):
                    drop_path(self.spark, aside)
                else:
                    move_path(self.spark, aside, place)


def scan_history(docs: DataFrame, ledger: BlobLedger | None = None, path_column: str = "doc_id", text_column: str = "text", base_kinds: int = 3) -> DataFrame:
    """Scans all versions ``docs`` and gives each path its findings.

    Returns ``path_column, n_<kind> long`` for each kind, ``base_spans`` and ``spans`` (strings of
    ``kind:start:end`` by start, then kind, joined by commas; the first with the base kinds only).
    Null texts are empty; very long texts are scanned whole, in time that grows with their length
    alone. Each row of ``docs`` gives one row, repeated rows too; other columns are not read. Empty tables give empty results.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    rules = ledger.rules
    within = ledger.scan(docs, text_column)
    number = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    found = ledger.findings(within).distinct().withColumn("kind", number[F.col("rule")]).where("kind is not null")
    span = F.struct("start", "kind", F.concat_ws(":", F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind") + 1), F.col("start").cast("string"), F.col("end").cast("string")).alias("said"))
    # Written, so that both sides of the join are plain exchanges: then a blob that many paths hold
    # is split over tasks, or the findings are broadcast if they turn out small.
    of_blob = materialize(found.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("all")), "blob-findings")
    paths = docs.select(F.col(path_column), blob_of(text_of(text_column)).alias("blob"))
    joined = paths.join(of_blob, "blob", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<start:int,kind:int,said:string>>")))

    def count(kind: int) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{r.kind}": count(i) for i, r in enumerate(rules)}
    said = lambda spans: F.array_join(F.transform(spans, lambda s: s["said"]), ",")
    return joined.withColumns(counts | {"base_spans": said(F.filter("all", lambda s: s["kind"] < base_kinds)), "spans": said(F.col("all"))}).drop("blob", "all")
