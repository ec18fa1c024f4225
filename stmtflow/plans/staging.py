"""Views of the given tables in the shape of statements, ledger, budget store and run log.

Only renames, string building and calendar splits happen here; all rows of the tables take part.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtflow.functions.identity import imported_id
from stmtflow.operators import fetch, keys
from stmtflow.schemas import TXN_CONTENT
from stmtflow.session import cut_lineage, shared_folder
from stmtflow.sources.profiles import profiles_frame, resolve_profiles

WIDE = ("lineitem", "orders")
BLOCK_ROWS = 8_000_000  # rows per block of a document that comes from a table
FIRST_IMPORT = datetime(2000, 1, 2)
THIS_IMPORT = datetime(2002, 1, 1)


class Tables:
    """The given tables of one folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in WIDE:
            # a small file is one split; spread it so that all cores share the work
            cores = self.spark.sparkContext.defaultParallelism
            if df.rdd.getNumPartitions() < cores:
                return df.repartition(cores, df.columns[0])
        return df


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Derived inputs that stand for stored tables are written once per application and folder."""

    @functools.wraps(build)
    def read(t: Tables) -> DataFrame:
        key = (t.spark.sparkContext.applicationId, t.folder, build.__name__)
        if key not in _STORED:
            _STORED[key] = cut_lineage(build(t))
        return _STORED[key]

    return read


def text(value: str | Column) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def cents(value: Column) -> Column:
    return F.round(value * 100).cast("bigint")


# --- statements from lineitem -----------------------------------------------------------------


def statement_rows(t: Tables) -> DataFrame:
    """Two overlapping exports per source. The second export writes some purposes differently."""
    day = F.to_date("l_shipdate")
    returned = F.col("l_returnflag") == "R"
    pending = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")
    first, second = day < "2000-01-01", day >= "1998-01-01"
    # constant lists: nothing is put together or filtered per row
    exports = (
        F.when(first & second, F.array(F.lit("a.csv"), F.lit("b.csv")))
        .when(first, F.array(F.lit("a.csv"))).when(second, F.array(F.lit("b.csv")))
    )
    rewritten = (F.col("doc") == "b.csv") & (F.col("l_returnflag") == "A")
    return (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .withColumn("doc", F.explode(exports))
        .select(
            F.concat(F.lit("src"), text("s_nationkey")).alias("source_id"),
            F.concat(F.lit("acct"), text("s_nationkey")).alias("account_ref"),
            "doc",
            F.expr(f"(l_orderkey * 8 + l_linenumber) div {BLOCK_ROWS}").alias("block"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_no"),
            day.alias("booking_date"),
            F.when(F.col("l_linestatus") == "F", F.date_add(day, 1)).alias("value_date"),
            (
                F.when(returned, 1).otherwise(-1)
                * (F.floor(F.col("l_quantity") / 5) * 500 + 500)
            ).cast("bigint").alias("amount_cents"),
            F.when(F.col("l_linestatus") == "F", "EUR").otherwise("eur").alias("currency"),
            F.col("s_name").alias("counterpart_name"),
            F.concat(
                F.lit("DE00 5001 "), F.lpad(text("s_suppkey"), 10, "0"), F.lit(" 11")
            ).alias("counterpart_iban"),
            F.when(rewritten, "  delivery  from WAREHOUSE ").otherwise("Delivery from warehouse").alias("purpose"),
            F.when(returned, "Gutschrift").when(pending, "Vorgemerkt Lastschrift").otherwise("SEPA-Lastschrift").alias("posting_text"),
            F.when(returned, F.concat(F.lit("R"), text("l_orderkey"))).alias("bank_reference"),
            F.when(returned & (F.col("l_linestatus") == "F"), F.concat(F.lit("E2E-"), text("l_orderkey"))).alias("end_to_end_id"),
            pending.alias("pending"),
            "l_returnflag",
            "l_linestatus",
            "l_linenumber",
        )
    )


def fetched(t: Tables) -> DataFrame:
    return fetch.fetch_transactions(statement_rows(t))


def ledger_before(t: Tables) -> DataFrame:
    """The stored ledger; import ids follow from the keys and are not written."""
    before = _ledger_before(t)
    return before.select(*KEY_COLUMNS, imported_id("source_id", "source_key").alias("imported_id"), *before.columns[2:])


KEY_COLUMNS = ["source_id", "source_key"]


@stored
def _ledger_before(t: Tables) -> DataFrame:
    """State after an earlier import of the first export, when the bank wrote some rows in capitals."""
    earlier = (
        statement_rows(t)
        .where("doc = 'a.csv'")
        .withColumn(
            "purpose",
            F.when(F.col("l_linestatus") == "F", F.upper("purpose")).otherwise(F.col("purpose")),
        )
    )
    at = F.lit(FIRST_IMPORT).cast("timestamp")
    return keys.assign_keys(fetch.booked(earlier)).select(
        *KEY_COLUMNS,
        F.col("account_ref").alias("actual_account_id"),
        "booking_date",
        "amount_cents",
        "raw_fingerprint",
        F.lit("run0").alias("first_run_id"),
        F.lit("run0").alias("last_run_id"),
        at.alias("first_seen_at"),
        at.alias("last_seen_at"),
    )


# --- registry and accounts from nation and region ---------------------------------------------


def sources(t: Tables) -> DataFrame:
    """Configured sources; one region has been removed from the configuration."""
    return every_source(t).where("r_name <> 'MIDDLE EAST'").drop("r_name")


def every_source(t: Tables) -> DataFrame:
    """All sources that files come from, configured or not."""
    bank = ~F.col("r_name").isin("AFRICA", "MIDDLE EAST")
    return (
        t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("src"), text("n_nationkey")).alias("id"),
            F.lit("manual_import").alias("connector"),
            F.col("n_name").alias("actual_account"),
            F.concat(F.lit("acct"), text("n_nationkey")).alias("account_ref"),
            F.lit("EUR").alias("currency"),
            F.when(bank, "postbank-csv").otherwise("generic-csv").alias("format"),
            F.concat(F.lit("source_id=src"), text("n_nationkey"), F.lit("/*/*.txt")).alias("inbox_glob"),
            F.when(
                F.col("r_name") == "ASIA", F.create_map(F.lit("purpose"), F.lit("Buchungstext"))
            ).alias("format_overrides"),
            F.col("n_nationkey").alias("position"),
            "r_name",
        )
    )


def accounts(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("acct"), text("n_nationkey")).alias("id"),
        F.col("n_name").alias("name"),
        (F.col("r_name") == "ASIA").alias("off_budget"),
        (F.col("n_name") == "NATION_24").alias("closed"),
    )


# --- run log from events ----------------------------------------------------------------------


def runs(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    ok = kind.isin("click", "purchase")
    value = cents(F.col("value"))
    at = F.col("ts").cast("timestamp")
    status = (
        F.when(ok, "ok").when(kind == "view", "fetched").when(kind == "signup", "abandoned").otherwise("error")
    )
    day = F.to_date("ts")
    return t.events.select(
        F.concat(F.lit("run"), text("event_id")).alias("id"),
        F.concat(F.lit("src"), text(F.col("user_id") % 25)).alias("source_id"),
        at.alias("started_at"),
        F.when(kind != "view", at + F.expr("interval 1 minute")).alias("finished_at"),
        F.date_sub(day, 30).alias("window_from"),
        day.alias("window_to"),
        value.alias("fetched"),
        F.when(ok, value).otherwise(0).alias("new_rows"),
        F.lit(0).cast("bigint").alias("updated_rows"),
        F.lit(0).cast("bigint").alias("unchanged_rows"),
        F.lit(0).cast("bigint").alias("pending_rows"),
        status.alias("status"),
        F.when(kind == "error", "cannot parse amount").alias("error"),
        F.when(kind == "purchase", "api").otherwise("cli").alias("trigger_source"),
        F.when(kind.isin("click", "error", "purchase"), value * 100).alias("statement_balance_cents"),
        F.when(kind == "click", day).alias("statement_balance_date"),
        F.when(kind.isin("click", "signup"), value * 100 - F.col("user_id")).alias("actual_balance_cents"),
    )


def run_events(t: Tables) -> DataFrame:
    """The same runs as start and finish events."""
    finished = runs(t).withColumn("seq", F.lit(2))
    started = finished.select(
        *[
            F.col(c)
            if c in ("id", "source_id", "started_at", "trigger_source")
            else F.lit("fetched").alias(c)
            if c == "status"
            else F.lit(1).alias(c)
            if c == "seq"
            else F.lit(None).cast(finished.schema[c].dataType).alias(c)
            for c in finished.columns
        ]
    )
    return started.unionByName(finished.where("finished_at is not null"))


# --- budget store -----------------------------------------------------------------------------


@stored
def budget_transactions(t: Tables) -> DataFrame:
    """Store before the import: rows imported earlier, manual entries and rows of other imports.

    Manual entries stand for rows of the second export, dated up to three days off.
    """
    merged = fetched(t)
    imported = F.col("doc") == "a.csv"
    early = F.quarter("booking_date") <= 2
    # written by a run that ended before its ledger was
    unrecorded = ~imported & early & (F.col("amount_cents") > 0)
    weekend = F.dayofweek("booking_date").isin(1, 7)
    shift = F.dayofmonth("booking_date") % 7 - 3
    own = imported | unrecorded
    return merged.where(own | ~early).select(
        F.sha2(F.concat_ws("/", "source_id", "source_key"), 256).alias("id"),
        F.col("account_ref").alias("account_id"),
        F.when(own & weekend, F.date_add("booking_date", 2))
        .when(own, F.col("booking_date"))
        .otherwise(F.date_add("booking_date", shift.cast("int")))
        .alias("booking_date"),
        "amount_cents",
        F.when(own | ~weekend, F.col("counterpart_name")).alias("payee"),
        F.when(own, F.col("purpose")).alias("notes"),
        F.when(own, F.col("imported_id"))
        .when(F.month("booking_date") == 12, F.concat(F.lit("other:"), "source_key"))
        .alias("imported_id"),
        (own & ~weekend).alias("cleared"),
        F.when(own, F.col("counterpart_name")).alias("imported_payee"),
    )


def booked_transactions(t: Tables) -> DataFrame:
    """Every line item as a transaction of the budget, with payee, category and notes."""
    uncategorised = F.col("l_returnflag") == "N"
    return (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat_ws(
                "-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey"), text(cents(F.col("l_extendedprice")))
            ).alias("id"),
            F.concat(F.lit("acct"), text("s_nationkey")).alias("account_id"),
            F.to_date("l_shipdate").alias("booking_date"),
            (
                F.when(F.col("l_linestatus") == "F", 1).otherwise(-1) * cents(F.col("l_extendedprice"))
            ).alias("amount_cents"),
            F.concat(F.lit("payee"), text("l_suppkey")).alias("payee_id"),
            F.concat_ws(" ", "s_name", "p_type").alias("imported_payee"),
            F.when(~uncategorised, F.concat_ws("/", "p_type", "p_brand")).alias("category_id"),
            F.concat(F.lit("Order "), text("l_orderkey"), F.lit("  "), F.col("p_name")).alias("notes"),
            (F.col("l_linenumber") == 7).alias("is_parent"),
            (F.col("l_discount") == 0).alias("tombstone"),
            F.when(F.col("l_tax") > 0, (F.col("l_tax") == F.lit(0.08))).alias("starting_balance_flag"),
        )
    )


def payees(t: Tables) -> DataFrame:
    """Two payees may share a name; accounts in debt are transfers."""
    return t.supplier.select(
        F.concat(F.lit("payee"), text("s_suppkey")).alias("id"),
        F.concat(F.lit("Shop "), text(F.expr("s_suppkey div 2"))).alias("name"),
        F.when(F.col("s_acctbal") < 0, F.concat(F.lit("acct"), text("s_nationkey"))).alias("transfer_acct"),
        F.lit(False).alias("tombstone"),
        F.col("s_suppkey").alias("position"),
    )


def categories(t: Tables) -> DataFrame:
    return t.part.select("p_type", "p_brand").distinct().select(
        F.concat_ws("/", "p_type", "p_brand").alias("id"),
        F.concat_ws(" ", "p_brand", "p_type").alias("name"),
        F.col("p_type").alias("group_id"),
        (F.col("p_brand") == "Brand#13").alias("hidden"),
        (F.col("p_brand") == "Brand#25").alias("tombstone"),
    )


def category_groups(t: Tables) -> DataFrame:
    return t.part.select("p_type").distinct().select(
        F.col("p_type").alias("id"),
        F.initcap("p_type").alias("name"),
        (F.col("p_type") == "PROMO").alias("tombstone"),
    )


def content_columns() -> list[str]:
    return list(TXN_CONTENT)


def openings(t: Tables) -> DataFrame:
    """Opening rows that some accounts already have."""
    return (
        t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .where("r_name in ('AMERICA', 'EUROPE')")
        .select(
            F.concat(F.lit("open"), text("n_nationkey")).alias("id"),
            F.concat(F.lit("acct"), text("n_nationkey")).alias("account_id"),
            F.lit("1994-12-31").cast("date").alias("booking_date"),
            (F.col("n_nationkey") * 1000).cast("bigint").alias("amount_cents"),
            F.concat(F.lit("src"), text("n_nationkey"), F.lit(":starting-balance")).alias("imported_id"),
            F.lit(True).alias("starting_balance_flag"),
            F.lit(False).alias("tombstone"),
            F.lit(False).alias("is_parent"),
        )
    )


def all_transactions(t: Tables) -> DataFrame:
    return booked_transactions(t).unionByName(openings(t), allowMissingColumns=True)


def rules(t: Tables) -> DataFrame:
    """One rule per supplier; its kind follows from the supplier's nation."""
    payee = F.concat(F.lit("payee"), text("s_suppkey"))
    neighbour = F.concat(F.lit("payee"), text(F.col("s_suppkey") + 1))
    brand = F.concat(F.lit("Brand#"), text(F.col("s_nationkey") + 1))
    is_payee = F.struct(F.lit("description").alias("field"), F.lit("is").alias("op"), payee.alias("value"))
    contains = F.struct(
        F.lit("imported_description").alias("field"),
        F.lit("contains").alias("op"),
        F.concat(F.substring("s_name", 5, 20), F.lit(" promo")).alias("value"),
    )
    one_of = F.to_json(
        F.array(
            F.struct(
                F.lit("description").alias("field"), F.lit("oneOf").alias("op"),
                F.array(neighbour, payee).alias("value"),
            )
        )
    )
    nation = F.col("s_nationkey")
    sets = F.struct(F.lit("category").alias("field"), F.lit("set").alias("op"),
                    F.concat(F.lit("ECONOMY/"), brand).alias("value"))
    notes = F.struct(F.lit("notes").alias("field"), F.lit("set").alias("op"), F.lit("seen").alias("value"))
    return t.supplier.select(
        F.concat(F.lit("rule"), text("s_suppkey")).alias("id"),
        F.col("s_suppkey").alias("rule_order"),
        F.when(nation < 6, F.to_json(F.array(is_payee)))
        .when(nation < 12, one_of)
        .when(nation < 18, F.to_json(F.array(contains)))
        .when(nation < 22, F.to_json(F.array(contains, is_payee)))
        .otherwise("not json")
        .alias("conditions"),
        F.when(nation == 3, F.to_json(F.array(notes))).otherwise(F.to_json(F.array(notes, sets))).alias("actions"),
        (nation == 5).alias("tombstone"),
    )


def proposals_before(t: Tables) -> DataFrame:
    """Review queue: one proposal per payee name, in several states."""
    shop = F.concat(F.lit("Shop "), text(F.expr("s_suppkey div 2")))
    by_name = t.supplier.groupBy(shop.alias("payee")).agg(
        F.min("s_suppkey").alias("k"), F.min("s_nationkey").alias("n"), F.max("s_acctbal").alias("v")
    )
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return by_name.where("n < 15").select(
        F.md5("payee").alias("id"),
        "payee",
        F.concat(F.lit("Brand#"), text(F.col("n") + 1), F.lit(" LARGE")).alias("category"),
        F.least(F.round(F.abs("v") / 10000, 3), F.lit(1.0)).cast("decimal(4,3)").alias("confidence"),
        F.lit("looks alike").alias("reason"),
        F.when(F.col("n") != 7, F.col("k")).alias("tx_count"),
        cents(F.col("v")).alias("avg_amount_cents"),
        F.array("payee").alias("snippets"),
        F.lit("m0").alias("model"),
        F.when(F.col("n") < 4, "rejected").when(F.col("n") < 6, "approved").otherwise("pending").alias("status"),
        (start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("n").cast("int"))).alias("created_at"),
        F.when(F.col("n") < 6, start).alias("decided_at"),
        F.lit(None).cast("string").alias("rule_id"),
    )


def raw_proposals(t: Tables) -> DataFrame:
    """One JSON answer per supplier with a loosely written, an unknown and a referenced proposal."""
    shop = F.concat(F.lit("  SHOP-"), text(F.expr("s_suppkey div 2")), F.lit("!"))
    category = F.concat(F.lit("brand "), text(F.col("s_nationkey") + 1), F.lit("  large"))
    null = F.lit(None).cast("string")

    def proposal(ref, payee, category_ref, category, confidence, reason):
        return F.struct(
            ref.alias("ref"), payee.alias("payee"), category_ref.alias("category_ref"),
            category.alias("category"), confidence.alias("confidence"), reason.alias("reason"),
        )

    nation = F.col("s_nationkey")
    answers = F.array(
        proposal(null, shop, null, category, text(F.round(F.col("s_acctbal") / 5000, 2)), F.repeat(F.lit("because "), 50)),
        proposal(null, F.concat(F.lit("Nobody "), "s_name"), null, category, F.lit("high"), null),
        proposal(
            F.concat(F.lit(" P"), text(nation + 1)), F.lit("?"),
            F.concat(F.lit("C"), text(nation * 10)), F.lit("none such"), F.lit("0.5"), F.col("s_name"),
        ),
    )
    return t.supplier.select(
        F.lpad(text("s_suppkey"), 12, "0").alias("doc"),
        F.to_json(F.struct(answers.alias("proposals"))).alias("json"),
    )


# --- statement files from orders and customer --------------------------------------------------

# order of the columns in a file of each format; BIC is a column no profile reads
BANK_FILE = [
    "booking_date", "value_date", "posting_text", "counterpart_name", "purpose", "counterpart_iban",
    None, "end_to_end_id", "amount", "debit", "credit", "currency",
]
GENERIC_FILE = [
    "booking_date", "value_date", "amount", "currency", "counterpart_name", "counterpart_iban",
    "purpose", "posting_text", "bank_reference",
]
LAST_BLOCK = 1 << 40


def _german(amount: Column) -> Column:
    return _germanised(F.format_number(amount, 2))


def _germanised(number: Column) -> Column:
    return F.translate(number, ",.", ".,")


def _money(value: Column) -> Column:
    return (value.cast("decimal(18,2)") / 100).cast("decimal(18,2)")


def statement_cells(t: Tables) -> DataFrame:
    """Orders as the text cells a bank would write; one document per source and year, also of sources nobody claims."""
    formats = every_source(t).select(F.col("id").alias("source_id"), (F.col("format") == "postbank-csv").alias("bank"))
    up = F.col("o_orderpriority").isin("1-URGENT", "4-NOT SPECIFIED")
    value = cents(F.col("o_totalprice"))
    # step by step, so that no expression is repeated inside another one: code in one piece that is too long stays interpreted
    orders = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("source_id", F.concat(F.lit("src"), text("c_nationkey")))
        .join(formats, "source_id")
        .select(
            "source_id", "bank", "o_orderkey", "c_custkey", "c_name",
            F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"),
            F.concat(F.lit("Auftrag "), text("o_orderkey")).alias("order"),
            F.format_number(_money(F.when(up, value).otherwise(-value)), 2).alias("number"),
        )
    )
    day, kind, status, bank, order = map(F.col, ("day", "kind", "status", "bank", "order"))
    empty = F.lit("")
    purpose = (
        F.when(kind == "1-URGENT", F.concat(F.lit('"'), order, F.lit(' ""eilig""; sofort"')))
        .when(kind == "2-HIGH", F.concat(F.lit("  "), order, F.lit("  ")))
        .when(kind == "3-MEDIUM", F.concat(order, F.lit(' 24" Monitor')))
        .when(kind == "5-LOW", F.concat(F.lit('"'), order, F.lit('\nspäter"')))
        .otherwise(empty)
    )
    dated = orders.withColumns({
        "german": _germanised(F.col("number")),
        "booking_date": F.when(bank, F.date_format(day, "d.M.yyyy")).otherwise(day.cast("string")),
        "value_date": F.when(status == "O", F.date_add(day, 1).cast("string"))
        .when(status == "F", F.date_format(F.date_add(day, 2), "d.M.yyyy"))
        .otherwise("n/a"),
        "purpose": purpose,
    })
    german = F.col("german")
    cells = {
        "posting_text": F.when(status == "P", "Vorgemerkt Kartenzahlung").when(status == "F", "SEPA-Lastschrift").otherwise(empty),
        "counterpart_name": F.when(status == "F", empty).otherwise(F.concat(F.lit("Käufer "), "c_name")),
        "counterpart_iban": F.when(status == "O", empty).otherwise(F.concat(F.lit("DE00 1111 "), F.lpad(text("c_custkey"), 10, "0"))),
        "end_to_end_id": F.when(status == "O", F.concat(F.lit("E2E-"), text("o_orderkey"))).otherwise(empty),
        "bank_reference": F.when(status == "O", F.concat(F.lit("R-"), text("o_orderkey"))).otherwise(empty),
        "amount": F.when(~bank, F.col("number"))
        .when(kind == "4-NOT SPECIFIED", F.concat(german, F.lit(" EUR")))
        .when(kind == "5-LOW", german)
        .otherwise(empty),
        "debit": F.when(kind.isin("2-HIGH", "3-MEDIUM"), german).otherwise(empty),
        "credit": F.when(kind == "1-URGENT", german).otherwise(empty),
        "currency": F.when(status == "O", "EUR").when(status == "F", empty).otherwise("usd "),
    }

    def row(layout: list[str | None]) -> Column:
        return F.concat_ws(";", *[F.col(c) if c else empty for c in layout])

    return dated.withColumns(cells).select(
        "source_id",
        F.year(day).alias("year"),
        F.col("o_orderkey").alias("row_no"),
        F.when(bank, row(BANK_FILE)).otherwise(row(GENERIC_FILE)).alias("text"),
    )


@stored
def statement_lines(t: Tables) -> DataFrame:
    """The physical lines of those documents, with preamble, header, footer and encoding."""
    rows = statement_cells(t)
    body = rows.select(
        "source_id", "year",
        F.expr(f"row_no div {BLOCK_ROWS}").alias("block"),
        (F.col("row_no") * 2).alias("_first"),
        F.posexplode(F.split("text", "\n")).alias("_i", "text"),
    ).select("source_id", "year", "block", (F.col("_first") + F.col("_i")).alias("line_no"), "text")

    formats = resolve_profiles(every_source(t).drop("r_name"), profiles_frame(t.spark))
    documents = rows.select("source_id", "year").distinct().join(formats, "source_id")
    header = F.when(
        F.col("format") == "postbank-csv",
        F.concat_ws(";", *[F.col("columns")[c] if c else F.lit("BIC") for c in BANK_FILE]),
    ).otherwise(F.concat_ws(";", *[F.col("columns")[c] for c in GENERIC_FILE]))
    nation = F.regexp_extract("source_id", r"\d+", 0).cast("bigint")
    stated = nation * 100_000 + F.col("year")
    closing = F.concat(F.lit("Kontostand am 31.12."), text("year"))
    bank_lines = F.array(
        F.lit("Umsätze;;;"),
        F.lit('"Kontoinhaber";"Max ""M."" Mustermann"'),
        F.lit(""),
        F.concat(F.lit("Letzter Kontostand;;;;"), _german(_money(stated)), F.lit(";EUR")),
        F.when(nation % 2 == 0, F.concat(closing, F.lit(";;"), _german(_money(stated + 100)), F.lit(";;"))).otherwise("Hinweis;;"),
        header,
    )
    generic_lines = F.array(F.concat(F.lit("Balance;"), _money(stated).cast("string")), header)
    above = F.when(F.col("format") == "postbank-csv", bank_lines).otherwise(generic_lines)
    preamble = documents.select(
        "source_id", "year", F.lit(-1).cast("bigint").alias("block"), F.posexplode(above).alias("line_no", "text")
    )
    footer = documents.select(
        "source_id", "year", F.lit(LAST_BLOCK).alias("block"),
        F.posexplode(F.array(F.concat(closing, F.lit(";;;1,00;EUR")), F.lit(""))).alias("line_no", "text"),
    )
    lines = body.unionByName(preamble).unionByName(footer)
    # odd years were exported in a one-byte encoding
    latin = F.encode("text", "ISO-8859-1").cast("string")
    return lines.select(
        "source_id",
        F.concat(text("year"), F.lit(".csv")).alias("doc"),
        "block",
        F.col("line_no").cast("bigint").alias("line_no"),
        F.concat(F.when(F.col("year") % 2 == 1, latin).otherwise(F.col("text")), F.lit("\r")).alias("raw"),
        F.make_timestamp(F.col("year") + 1, F.lit(1), F.lit(5), F.lit(0), F.lit(0), F.lit(0)).alias("modified_at"),
    )


_INBOXES: dict[tuple[str, str], str] = {}


def statement_inbox(t: Tables) -> str:
    """Folder with those documents as files, one file per source and year."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _INBOXES:
        folder = f"{shared_folder(t.spark)}/inbox-{uuid.uuid4().hex}"
        (
            statement_lines(t)
            .repartition("source_id", "doc")
            .sortWithinPartitions("source_id", "doc", "block", "line_no")
            .select("source_id", "doc", "raw")
            .write.partitionBy("source_id", "doc")
            .text(folder)
        )
        _INBOXES[key] = folder
    return _INBOXES[key]
