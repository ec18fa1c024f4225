"""Quality rules with risk-controlled cutoffs [native].

A rule rejects a document whose measure exceeds a cutoff. Which cutoff is safe is not guessed: on labelled
holdouts, per stratum, the cutoffs of a fixed grid are tested from the loosest on. The hypothesis "more than
``risk`` of the good documents are rejected" must be refuted by the exact binomial tail; the first cutoff that
cannot refute it ends the sequence (fixed-sequence testing needs no correction inside a sequence), and the
level is divided by the number of rules and strata (Bonferroni). ``risk`` is split over the rules, so all of a
stratum's rules together wrongly reject more than ``risk`` with probability ``level`` at most. A stratum with
too few holdouts gets no cutoff and rejects nothing beyond the base.

Defined results: null text counts as empty and fails the base; a null stratum is a stratum of its own; several
labels of one document count as good only if all are good; repeated rows are judged alike; empty tables give
no rows and no cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtflow.llm.common import WORD_GAP, column_of, fenced, let
from stmtflow.session import cut_lineage

RISK, LEVEL = 0.02, 0.05
MIN_WORDS = 50
#: Cutoffs per rule, loosest first. Each is a share of words, lines or characters, or a mean length.
GRID = {
    "repeat_share": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "dup_line_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1],
    "symbol_share": [1.0, 0.5, 0.3, 0.2, 0.1, 0.05],
    "upper_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2],
    "mean_length": [40.0, 30.0, 20.0, 15.0, 12.0, 10.0],
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window which the text holds twice or more."""

    def of_windows(windows: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            repeated = F.filter(s, lambda _, i: same(i, i - 1) | same(i, i + 1))
            starts = F.sort_array(F.transform(repeated, lambda e: e["at"]))
            zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
            step = lambda acc, p: F.struct(
                p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).cast("bigint").alias("n")
            )
            return F.aggregate(starts, zero, step, lambda acc: acc["n"])

        placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(
            let(F.sort_array(placed), of_sorted)
        )

    def of_hashes(h: Column) -> Column:
        n = F.size(h) - 2
        pairs = F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
        windows = F.zip_with(pairs, F.slice(h, F.lit(3), n), lambda a, b: F.xxhash64(a, b))
        return F.when(n < 2, F.lit(0).cast("bigint")).otherwise(let(windows, of_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def measures(text: Column) -> Column:
    """Struct of the base counts and the rules' measures of one text; evaluated once per row."""
    whole = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        chars = F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.char_length(w))
        lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            n.alias("n_words"),
            chars.alias("word_chars"),
            F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.struct(
                F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup")
            )).alias("lines"),
            _repeat_words(words).alias("n_repeat_words"),
            F.regexp_count(whole, F.lit("[A-Z]")).cast("bigint").alias("n_upper"),
        )

    return let(F.filter(F.split(whole, WORD_GAP), lambda w: w != ""), of_words)


def measured(docs: DataFrame, text: str, stratum: str) -> DataFrame:
    """Adds the base counts, the verdict of the base, the rules' measures (``_rules``) and ``_stratum``."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    m = docs.withColumn("_m", measures(F.col(text))).withColumns(
        {c: F.col(f"_m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words")}
        | {"n_dup_lines": F.col("_m.lines.dup")}
    )
    rules = {
        "repeat_share": share(F.col("n_repeat_words"), F.col("n_words")),
        "dup_line_share": share(F.col("n_dup_lines"), F.col("_m.lines.n")),
        "symbol_share": share(F.col("n_symbols"), F.col("n_words")),
        "upper_share": share(F.col("_m.n_upper"), F.col("word_chars")),
        "mean_length": share(F.col("word_chars"), F.col("n_words")),
    }
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.withColumns(
        {
            "base_failed": failed,
            "_rules": F.struct(*[c.alias(n) for n, c in rules.items()]),
            "_stratum": F.coalesce(F.col(stratum).cast("string"), F.lit("(none)")),
        }
    ).drop("_m")


def _lower_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exactly, for k below the mean; 1 from the mean on, where nothing can be refuted."""
    zero = F.struct((n * F.log(F.lit(1 - p))).alias("log"), F.lit(0.0).alias("sum"))
    odds = F.log(F.lit(p / (1 - p)))
    step = lambda acc, i: F.struct(
        (acc["log"] + F.log((n - i) / (i + 1.0)) + odds).alias("log"), (acc["sum"] + F.exp(acc["log"])).alias("sum")
    )
    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k), zero, step, lambda acc: acc["sum"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(tail)


def cutoffs(rows: DataFrame, labels: DataFrame, doc_id: str, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per stratum and rule: the tightest cutoff whose false rejections are bounded (none: no row).

    ``rows`` comes from :func:`measured`; ``labels`` has doc_id and quality (1: good).
    """
    good = (
        labels.where("quality is not null").groupBy(F.col("doc_id").alias("_label_id"))
        .agg(F.min("quality").alias("_q")).where("_q = 1").select("_label_id")
    )
    # no filter on a measure here: it would be pushed below and compute the measures twice
    held = rows.join(good, F.col(doc_id) == F.col("_label_id"), "left_semi")
    passed = ~F.col("base_failed")
    # one counting pass: a row per document becomes counters per stratum before anything is shuffled
    counts = [
        F.count_if(passed & (F.col(f"_rules.{rule}") > cut)).alias(f"{rule}_{i}") for rule, grid in GRID.items() for i, cut in enumerate(grid)
    ]
    per_stratum = held.groupBy("_stratum").agg(F.count_if(passed).alias("n"), *counts)
    tests = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(float(cut)).alias("cutoff"), F.col(f"{rule}_{i}").alias("k")
            )
            for rule, grid in GRID.items() for i, cut in enumerate(grid)
        ]
    )
    strata = rows.select("_stratum").distinct().agg(F.count(F.lit(1)).alias("_strata"))
    tested = (
        per_stratum.select("_stratum", "n", F.explode(tests).alias("t"))
        .select("_stratum", "n", "t.*")
        .withColumn("p", _lower_tail(F.col("k"), F.col("n"), risk / len(GRID)))
    )
    # the one row of the number of strata goes to the tests as a constant
    tests_made = max(1, strata.first()["_strata"]) * len(GRID)
    refuted = F.col("p") <= level / tests_made
    return (
        tested.groupBy("_stratum", "rule")
        .agg(
            F.min(F.when(~refuted, F.col("step"))).alias("stop"),
            F.collect_list(F.struct("step", "cutoff")).alias("grid"),  # as many as the grid has
        )
        .select(
            "_stratum", "rule",
            F.array_max(F.filter("grid", lambda g: F.col("stop").isNull() | (g["step"] < F.col("stop"))))["cutoff"].alias("cutoff"),
        )
        .where("cutoff is not null")
    )


def judged(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds ``kept``: passed the base and exceeds no cutoff of its stratum."""
    by_stratum = chosen.groupBy("_stratum").pivot("rule", list(GRID)).agg(F.first("cutoff"))
    over = F.lit(False)
    for rule in GRID:
        over = over | F.coalesce(F.col(f"_rules.{rule}") > F.col(f"_cut.{rule}"), F.lit(False))
    limits = by_stratum.select("_stratum", F.struct(*GRID).alias("_cut"))
    return rows.join(limits, "_stratum", "left").withColumn("kept", F.when(F.col("base_failed"), False).otherwise(~over)).drop("_cut")


def apply_rules(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", stratum: str = "lang",
    risk: float = RISK, level: float = LEVEL,
) -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and ``kept``.

    The measures are computed twice, once for the holdouts' counters and once beside the whole rows, so no text
    is written or shuffled.
    """
    inner, back = fenced(docs)
    names = {n: column_of(docs, n) for n in (text, doc_id, stratum)}
    rows = measured(inner, names[text], names[stratum])
    chosen = cut_lineage(cutoffs(rows, labels, names[doc_id], risk, level))
    return back(judged(rows, chosen), {c: c for c in [*BASE, "base_failed", "kept"]})


def report(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", stratum: str = "lang",
    risk: float = RISK, level: float = LEVEL,
) -> DataFrame:
    """Per document the counts and the verdict without the text; the counts are written once and read twice."""
    light = cut_lineage(
        measured(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.col(stratum).alias("_of")), "_text", "_of")
        .drop("_text", "_of")
    )
    chosen = cutoffs(light, labels, "doc_id", risk, level)
    return judged(light, chosen).select("doc_id", *BASE, "base_failed", "kept")
