"""The text a model is asked with, and the values its answer may use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The text of the request.
CATEGORY_TITLE = "## Categories ([ref] name — group)"
EXAMPLE_TITLE = "## How this household categorises (payee → category)"
CANDIDATE_TITLE = "## Payees without a category"
CLOSING = (
    "Return one proposal per payee listed above: its ref (p1, p2, ...) and a category_ref (c1, c2, ...)."
)
NO_NOTES = "(no purpose text)"


def direction(average: Column | str) -> Column:
    c = F.col(average) if isinstance(average, str) else average
    return F.when(c > 0, "income").otherwise("expense")


def whole_amount(cents: Column | str) -> Column:
    """Whole currency units without sign, ties to even."""
    c = F.col(cents) if isinstance(cents, str) else cents
    return F.bround(F.abs(c).cast("decimal(20,0)") / 100).cast("bigint").cast("string")


def candidate_line() -> Column:
    quoted = F.array_join(F.transform("snippets", lambda s: F.concat(F.lit('"'), s, F.lit('"'))), "; ")
    notes = F.when(F.size("snippets") > 0, quoted).otherwise(NO_NOTES)
    return F.concat(
        F.lit("- ["), "ref", F.lit("] "), "payee", F.lit(": "), F.col("tx_count").cast("string"),
        F.lit(" transactions, avg "), whole_amount("avg_amount_cents"), F.lit(" EUR "),
        direction("avg_amount_cents"), F.lit(", purpose: "), notes,
    )


def prompt_lines(categories: DataFrame, examples: DataFrame, candidates: DataFrame) -> DataFrame:
    """Sections and lines in order: ``section, position, line``."""
    spark = categories.sparkSession

    def lines(df: DataFrame, section: int, line: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.col("position").cast("bigint").alias("position"), line.alias("line"))

    fixed = spark.createDataFrame(
        [
            (1, -1, CATEGORY_TITLE),
            (3, -2, ""), (3, -1, CANDIDATE_TITLE),
            (4, 0, ""), (4, 1, CLOSING),
        ],
        "section int, position bigint, line string",
    )
    # the example title only stands over examples
    first_example = examples.where("position = 1")
    example_title = lines(first_example.withColumn("position", F.lit(-2)), 2, F.lit("")).unionByName(
        lines(first_example.withColumn("position", F.lit(-1)), 2, F.lit(EXAMPLE_TITLE))
    )
    category = F.concat(F.lit("- ["), "ref", F.lit("] "), "name", F.lit(" — "), "group")
    example = F.concat(F.lit("- "), "payee", F.lit(" → "), "category", F.lit("  ("), "source", F.lit(")"))
    return (
        fixed.unionByName(lines(categories, 1, category))
        .unionByName(example_title)
        .unionByName(lines(examples, 2, example))
        .unionByName(lines(candidates, 3, candidate_line()))
    )


def prompt(lines: DataFrame) -> DataFrame:
    """One text. Its size is that of one request: a budget's categories and two limited lists."""
    parts = F.sort_array(F.collect_list(F.struct("section", "position", "line")))
    return lines.agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("prompt"))


def allowed_values(categories: DataFrame) -> DataFrame:
    """Names and references an answer may use, without repetition."""
    names = categories.select(F.lit("category").alias("kind"), F.col("name").alias("value"))
    refs = categories.select(F.lit("category_ref").alias("kind"), F.col("ref").alias("value"))
    return names.unionByName(refs).distinct()
