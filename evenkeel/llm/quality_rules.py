"""Document quality: statistics of a text and decision lists learned from labelled ones.

All work on the documents is DataFrame functions. Learning takes a bounded sample of labelled
statistics; what it gives is an ordered list of threshold conjunctions, turned into one Spark
conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named_back, own_columns, renamed, strip_space, text_of, words_of

MIN_WORDS = 50
MAX_LABELLED = 8000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words_per_line", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share")


def add_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds the base statistics (long), ``base_failed`` and the columns of ``FEATURES`` (double).

    ``n_words``: words ``[^\\x20\\x09-\\x0D]+``; ``word_chars``: their code points; ``n_symbols``:
    characters of ``[#*$%&|<>]``; ``n_dup_lines``: lines with a word that equal an earlier line;
    ``n_repeat_words``: words that lie in a 3-word window found twice or more in the text. Windows
    are compared by a 64-bit hash within one text. Null texts have no words, and all shares of an
    empty text are 0. Columns of these names are replaced.
    """
    c = own_columns(docs, "text", "words", "windows", "sorted", "starts", "lines", "joined")
    col = {k: F.col(v) for k, v in c.items()}
    out = docs.withColumn(c["text"], text_of(text_column))
    out = out.withColumns({c["words"]: words_of(col["text"]), c["lines"]: F.filter(F.split(col["text"], "\n"), lambda x: strip_space(x) != "")})
    windows = F.when(F.size(col["words"]) < 3, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(col["words"]) - 3), lambda i: F.xxhash64(F.get(col["words"], i), F.get(col["words"], i + 1), F.get(col["words"], i + 2)))
    )
    out = out.withColumns({c["windows"]: windows, c["joined"]: F.array_join(col["words"], "")})
    # Only texts in which a window repeats need their windows sorted.
    pairs = F.sort_array(F.transform(col["windows"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn(c["sorted"], F.when(F.size(F.array_distinct(col["windows"])) == F.size(col["windows"]), none).otherwise(pairs))
    twice = F.filter(col["sorted"], lambda e, i: F.coalesce(e["h"] == F.get(col["sorted"], i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(col["sorted"], i + 1)["h"], F.lit(False)))
    out = out.withColumn(c["starts"], F.sort_array(F.transform(twice, lambda e: e["i"])))
    covered = F.aggregate(F.transform(col["starts"], lambda p, i: F.least(F.lit(3), F.coalesce(F.get(col["starts"], i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    out = out.withColumns({
        "n_words": F.size(col["words"]).cast("long"),
        "word_chars": F.char_length(col["joined"]).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(col["joined"], r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(col["lines"]) - F.size(F.array_distinct(col["lines"]))).cast("long"),
        "n_repeat_words": covered.cast("long"),
        "words_per_line": _share(F.size(col["words"]), F.size(col["lines"])),
        "dup_line_share": _share(F.size(col["lines"]) - F.size(F.array_distinct(col["lines"])), F.size(col["lines"])),
        "upper_share": _share(F.char_length(F.regexp_replace(col["joined"], r"[^A-ZÀ-ÖØ-Þ]+", "")), F.char_length(col["joined"])),
        "mark_share": _share(F.char_length(F.regexp_replace(col["joined"], r"[^!?]+", "")), F.char_length(col["joined"])),
    })
    out = out.withColumns({
        "mean_word": _share(F.col("word_chars"), F.col("n_words")),
        "symbol_share": _share(F.col("n_symbols"), F.col("word_chars")),
        "repeat_share": _share(F.col("n_repeat_words"), F.col("n_words")),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })
    # Through the generator no filter on a statistic is pushed down: it would be computed again there.
    added = [*BASE, "base_failed", *FEATURES]
    own = [x for x in docs.columns if x not in added]
    return out.select(*own, F.inline(F.array(F.struct(*added))))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(0.0)


@dataclass
class Rule:
    """A conjunction of (feature, above, threshold); a document that meets all is rejected."""

    terms: list[tuple[str, bool, float]] = field(default_factory=list)

    def holds(self, row: dict) -> bool:
        return all(row[f] > t if above else row[f] <= t for f, above, t in self.terms)

    def column(self) -> Column:
        out = F.lit(True)
        for f, above, t in self.terms:
            out = out & (F.col(f) > t if above else F.col(f) <= t)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>' if above else '<='} {t:.6g}" for f, above, t in self.terms)


def _best_term(rows: list[dict], features: tuple[str, ...]) -> tuple[float, tuple[str, bool, float] | None]:
    """The threshold test with the highest gain of information over the rows a rule covers."""
    p = sum(r["bad"] for r in rows)
    n = len(rows) - p
    if not p or not n:
        return 0.0, None
    before, best = math.log2(p / (p + n)), (0.0, None)
    for f in features:
        ordered = sorted(rows, key=lambda r: r[f])
        below_p = below_n = 0
        for r, after in zip(ordered, ordered[1:]):
            below_p += r["bad"]
            below_n += 1 - r["bad"]
            if r[f] == after[f]:
                continue
            cut = (r[f] + after[f]) / 2
            for above, pp, nn in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
                if pp and (gain := pp * (math.log2(pp / (pp + nn)) - before)) > best[0]:
                    best = gain, (f, above, cut)
    return best


def _worth(rule: Rule, rows: list[dict]) -> tuple[float, int]:
    """Share of bad rows among those covered, with two rows of doubt, and how many it covers."""
    covered = [r["bad"] for r in rows if rule.holds(r)]
    return (sum(covered) + 1) / (len(covered) + 2), len(covered)


def learn_decision_list(rows: list[dict], features: tuple[str, ...] = FEATURES, max_rules: int = 12, max_terms: int = 4, min_precision: float = 0.9) -> list[Rule]:
    """Learns an ordered list of rejecting rules by sequential covering.

    ``rows`` hold the features, ``bad`` (0 or 1) and ``prune`` (the third of the rows that judges
    rules). A rule is grown on the other rows, one threshold test after the other with the highest
    gain; then its last tests are cut off as long as it judges no worse. It is taken if it is
    precise enough on the rows kept for pruning, and the rows it covers are removed.
    """
    grow, prune = [r for r in rows if not r["prune"]], [r for r in rows if r["prune"]]
    rules: list[Rule] = []
    while len(rules) < max_rules and any(r["bad"] for r in grow):
        rule, covered = Rule(), grow
        while len(rule.terms) < max_terms:
            _, term = _best_term(covered, features)
            if term is None:
                break
            rule.terms.append(term)
            covered = [r for r in covered if rule.holds(r)]
        if not rule.terms:
            break
        shorter = [Rule(rule.terms[:k]) for k in range(len(rule.terms), 0, -1)]
        rule = max(shorter, key=lambda x: (_worth(x, prune)[0], -len(x.terms)))
        precision, n = _worth(rule, prune)
        if precision < min_precision or n < 5:
            break
        rules.append(rule)
        grow, prune = [r for r in grow if not rule.holds(r)], [r for r in prune if not rule.holds(r)]
    return rules


def labelled_statistics(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", max_labelled: int = MAX_LABELLED) -> list[dict]:
    """Features of at most ``max_labelled`` labelled documents, chosen by a hash of the id.

    The chosen ids, a table of bounded size, are broadcast. Labels other than 0 and 1 are left out.
    """
    chosen = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_label_id")).agg(F.min(label_column).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(3), "_label_id"), "_label_id").limit(max_labelled)
    found = docs.select(F.col(id_column).alias("_id"), text_of(text_column).alias("text")).join(F.broadcast(chosen), F.col("_id") == F.col("_label_id"))
    stats = add_statistics(found).where(~F.col("base_failed")).select("_id", "_label", *FEATURES)
    rows = stats.withColumn("prune", F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(3)) == 0).orderBy("_id", *FEATURES).limit(2 * max_labelled).collect()
    return [{"bad": 1 - r["_label"], "prune": r["prune"]} | {f: r[f] for f in FEATURES} for r in rows]


def verdict(rules: list[Rule]) -> Column:
    """The decision list as an expression: false at the first rule that holds, else true."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), F.lit(False))
    for rule in rules[1:]:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def judge_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Adds the base statistics, ``base_failed`` and ``kept`` to the columns of ``docs``.

    ``kept`` is false if the base rules fail (under 50 words, or over half of the words in repeated
    windows); else the learned decision list decides. Without labels of both kinds nothing more is
    rejected. Null and empty texts fail the base rules. Very
    long texts are judged whole: one row holds the arrays of their words and lines meanwhile. Repeated rows are judged alike; columns of
    the same names are replaced; empty tables give empty results.
    """
    rules = learn_decision_list(labelled_statistics(docs, labels, id_column, text_column, label_column, max_labelled))
    judged = add_statistics(docs, text_column)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules))
    extra = [f for f in FEATURES if f not in docs.columns]
    return judged.withColumn("kept", kept).drop(*extra)


def kept_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """The documents that ``judge_documents`` keeps, with the columns of ``docs`` as they are, whatever their names."""
    plain, own = renamed(docs)
    marked = labels.select(F.col(id_column).alias(own[id_column]), F.col(label_column).alias("label"))
    return named_back(judge_documents(plain, marked, own[id_column], own[text_column], "label").where("kept"), own)
