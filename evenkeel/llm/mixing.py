"""Mixing sources to target weights with hash-random keys and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, dense_rank_positions, materialize, own_columns, row_key, text_of

CYCLE = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-0"
#: Rows of the largest source that a range of keys holds, on average.
RANGE_ROWS = 20_000


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def random_key(id_column: str, text: Column, seed: str = SEED) -> Column:
    """A hash-random key in hexadecimal; the same for every run of one seed.

    It is a hash of the id, and of the text where the id is null: rows without ids are spread too.
    """
    return F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("null:"), F.md5(text))), F.lit(f":{seed}")))


def range_bits(docs: DataFrame, source_column: str, rows: int = RANGE_ROWS) -> int:
    """Bits of the key that cut the largest source into ranges of about ``rows`` rows; 8 at least."""
    most = docs.groupBy(source_column).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return min(32, max(8, (max(1, most) // rows).bit_length()))


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of the sources ``sizes`` (source, source_size long): adds ``weight`` and ``target``.

    Sources take the weights of ``cycle`` in the order of their names, null last, and share the sum
    of all sizes by weight. A target stops at ``max_epochs`` times its source's size; the excess is
    shared again among the others by weight until no target is above. Each round is one
    aggregation that returns two numbers.
    """
    ranked = dense_rank_positions(sizes, [F.col("source").asc_nulls_last()], "mix-sources", "place")
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("place") % len(cycle) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weights).drop("place"), "mix-weights")
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = None
    while True:
        # Sources whose share at the last level is above their cap are held at the cap.
        held = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        row = ranked.agg(F.sum(F.when(held, cap).otherwise(0.0)).alias("held"), F.sum(F.when(held, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        new = (total - row["held"]) / row["open"]
        if new == level:
            break
        level = new
    if level is None:
        level = 0.0
    return ranked.withColumn("target", F.when(F.col("weight") * F.lit(level) > cap, cap).otherwise(F.col("weight") * F.lit(level)))


def mix_sources(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", cycle: tuple[int, ...] = CYCLE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, bits: int | None = None) -> DataFrame:
    """How often the mix takes each document.

    Returns ``id_column, source_column, mix_key, size, source_size, target, copies, taken``, one row
    for each row of ``docs``; ``size`` counts words (null texts: 0) and ``taken`` is
    ``copies * size``. A source's documents are ordered by a hash-random key and its target is cut
    into whole epochs and a rest. Every document is taken once for each epoch, and once more while
    the running sum is within the rest; the document at the cut is taken if that brings the source
    nearer to its target. Reruns agree.

    Keys are uniform, so the first ``bits`` bits of the key cut each source into ranges of even size;
    their number follows from the rows of the largest source unless it is given. A prefix sum is the sum of the ranges before (one row for each source and range) and
    the running sum within the range, so a source with most of the rows is spread over its ranges.

    The null source is a source of its own, after the others. Very long texts are counted whole without
    an array of their words. Empty texts have size 0 and are taken
    0 words. Equal keys (repeated ids) are ordered by size. Empty tables give empty results.
    """
    if bits is None:
        bits = range_bits(docs, source_column)
    base = docs.select(F.col(id_column), F.col(source_column).alias("source"), random_key(id_column, text_of(text_column), seed).alias("mix_key"), n_words(text_of(text_column)).alias("size"))
    base = base.withColumns({"range": F.shiftright(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long"), 32 - bits), "named": F.col("source").isNotNull(), "name": F.coalesce("source", F.lit(""))})
    # Sizes are counted in both passes rather than written: the sums are few rows in a few files.
    ranges = materialize(base.groupBy("named", "name", "range").agg(F.sum("size").alias("range_size")).coalesce(8), "mix-ranges")
    before = Window.partitionBy("named", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    sizes = ranges.groupBy("named", "name").agg(F.sum("range_size").alias("source_size")).select(F.when(F.col("named"), F.col("name")).alias("source"), "source_size")
    targets = source_targets(sizes, cycle, max_epochs).select(F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target")
    ranges = ranges.join(targets, ["named", "name"]).select("named", "name", "range", "before", "source_size", "target")
    inside = Window.partitionBy("named", "name", "range").orderBy("mix_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ranges, ["named", "name", "range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    placed = placed.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    more = (F.lit(2.0) * (F.col("rest") - (F.col("before") + F.col("inside"))) >= F.col("size")) & (F.col("rest") > 0)
    placed = placed.withColumn("copies", (F.col("epochs") + F.when(more, 1).otherwise(0)).cast("int"))
    return placed.select(id_column, F.col("source").alias(source_column), "mix_key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **settings) -> DataFrame:
    """The mix itself: each document as many times as the mix takes it, with the columns of ``docs``.

    Rows of one key, source and size are numbered by a digest of their text, and the k-th takes the
    k-th count of the mix. The key is that of ``mix_sources``, so rows without ids are told apart.
    """
    c = own_columns(docs, "key", "source", "none", "size", "turn", "copies", "copy")
    seed = settings.get("seed", SEED)
    named = {c["source"]: F.coalesce(F.col(source_column), F.lit("")), c["none"]: F.col(source_column).isNull()}
    plan = mix_sources(docs, id_column, text_column, source_column, **settings)
    plan = plan.select(F.col("mix_key").alias(c["key"]), *[v.alias(k) for k, v in named.items()], F.col("size").alias(c["size"]), F.col("copies").alias(c["copies"]))
    names = [c["key"], *named, c["size"]]
    plan = plan.withColumn(c["turn"], F.row_number().over(Window.partitionBy(*names).orderBy(F.desc(c["copies"]))))
    text = text_of(text_column)
    marked = docs.withColumns({c["key"]: random_key(id_column, text, seed)} | named | {c["size"]: n_words(text)})
    marked = marked.withColumn(c["turn"], F.row_number().over(Window.partitionBy(*names).orderBy(row_key(id_column, text))))
    joined = marked.join(plan, [*names, c["turn"]]).where(F.col(c["copies"]) > 0)
    return joined.withColumn(c["copy"], F.explode(F.sequence(F.lit(1), F.col(c["copies"])))).select(*docs.columns)
