"""Registered queries: one per operator, each over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtflow.functions import identity, masking, parsing, text
from stmtflow.operators import (
    balances,
    candidates,
    fetch,
    importing,
    keys,
    ledger,
    matching,
    prompts,
    proposals,
    reports,
    rules,
    runs,
)
from stmtflow.plans import staging as st
from stmtflow.plans.importer import ImportJob
from stmtflow.plans.review import ReviewRound
from stmtflow.schemas import TABLES
from stmtflow.session import cut_lineage, shared_folder
from stmtflow.sources import inbox, profiles, registry, statements
from stmtflow.sources.store import SnapshotStore
from stmtflow.streaming import inbox_stream

Query = Callable[[SparkSession, str], DataFrame]
STREAM_FILES = 64  # files of a micro-batch: about three of them
SEED_YEAR = 1997  # documents before it have been imported when the whole jobs start
QUERIES: dict[str, Query] = {}


def register(build: Callable[[st.Tables], DataFrame]) -> Callable[[st.Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(st.Tables(spark, folder))
    return build


def moment(name: str, alias: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(alias)


# --- keys, merge, ledger ----------------------------------------------------------------------


@register
def assign_keys(t):
    return keys.assign_keys(fetch.booked(st.statement_rows(t))).select(
        "source_id", "doc", "ordinal", "source_key", "imported_id", "raw_fingerprint",
        "booking_date", "amount_cents", "currency",
    )


@register
def fingerprint(t):
    return keys.assign_keys(fetch.booked(st.statement_rows(t))).select(
        "source_id", "doc", "source_key", "raw_fingerprint"
    )


@register
def merge_documents(t):
    return st.fetched(t).select(
        "source_id", "source_key", "doc", "imported_id", "raw_fingerprint", *st.content_columns()
    )


def _partitioned(t):
    return ledger.partition(st.fetched(t), st.ledger_before(t))


@register
def ledger_partition(t):
    return _partitioned(t).select(
        "source_id", "source_key", "imported_id", "booking_date", "amount_cents", "dedup_status"
    )


@register
def partition_counts(t):
    return ledger.partition_counts(_partitioned(t))


@register
def pending_split(t):
    return fetch.pending_split(st.statement_rows(t))


@register
def fetch_stats(t):
    return fetch.fetch_stats(st.fetched(t), fetch.pending_split(st.statement_rows(t)))


@register
def payee_name(t):
    return st.fetched(t).select("source_id", "source_key", identity.payee_name().alias("payee_name"))


@register
def earliest_booking(t):
    return ledger.earliest_booking(st.ledger_before(t))


@register
def ledger_size(t):
    return ledger.ledger_size(st.ledger_before(t))


@register
def orphan_sources(t):
    return ledger.orphan_sources(st.ledger_before(t), st.sources(t))


def _account_of_source(t):
    return t.nation.select(
        F.concat(F.lit("src"), st.text("n_nationkey")).alias("source_id"),
        F.concat(F.lit("acct"), st.text("n_nationkey")).alias("actual_account_id"),
    )


def _day(name: str, alias: str):
    return F.to_date(name).cast("string").alias(alias)


def _recorded(t, *statuses):
    return ledger.record_fetched(st.fetched(t), st.ledger_before(t), list(statuses), _account_of_source(t), "run1", _this_import())


@register
def ledger_record(t):
    after = _recorded(t, ledger.NEW, ledger.CHANGED)
    return after.select(
        "source_id", "source_key", "imported_id", "actual_account_id", "booking_date",
        "amount_cents", "raw_fingerprint", "first_run_id", "last_run_id",
        _day("first_seen_at", "first_seen"), _day("last_seen_at", "last_seen"),
    )


@register
def ledger_touch(t):
    after = _recorded(t, ledger.UNCHANGED)
    return after.select("source_id", "source_key", "last_run_id", _day("last_seen_at", "last_seen"))


def _this_import():
    return F.lit(st.THIS_IMPORT).cast("timestamp")


@register
def forget_source(t):
    return ledger.forget_source(st.ledger_before(t), ["src3", "src7"]).select("source_id", "source_key")


# --- runs -------------------------------------------------------------------------------------

_RUN_STATE = ["id", "source_id", "status", "error"]


def _restart():
    return F.to_timestamp(F.lit("2024-01-20 00:00:00"))


@register
def run_log(t):
    return runs.current_runs(st.run_events(t)).select(
        *_RUN_STATE, "statement_balance_cents", moment("finished_at", "finished")
    )


@register
def abandon_runs(t):
    return runs.abandon_stale(st.runs(t), _restart()).select(
        *_RUN_STATE, moment("finished_at", "finished")
    )


@register
def expire_runs(t):
    return runs.expire(st.runs(t), _restart()).select(
        *_RUN_STATE, moment("finished_at", "finished")
    )


@register
def latest_statement_balance(t):
    return runs.latest_statement_balance(st.runs(t)).select(
        "source_id", "statement_balance_cents", "statement_balance_date", moment("seen_at", "seen")
    )


@register
def recent_runs(t):
    return runs.recent_runs(st.runs(t)).select(*_RUN_STATE, "statement_balance_cents")


@register
def source_status(t):
    return runs.source_status(
        st.sources(t), ledger.ledger_size(st.ledger_before(t)), st.runs(t)
    )


@register
def balance_drift(t):
    return runs.balance_drift(st.runs(t))


@register
def source_lookup(t):
    requested = st.runs(t).select("source_id").distinct()
    return registry.lookup(requested, registry.registry(st.sources(t))).select(
        "source_id", "actual_account", "account_ref", "format", "error"
    )


# --- matching and import ----------------------------------------------------------------------


def _resolved(t):
    return importing.resolve_accounts(st.sources(t), st.accounts(t))


def _importable(t):
    return importing.importable(_partitioned(t), _resolved(t))


def _importable_cut(t, *left_out):
    """The same as a written table, before the budget is looked at: what the fetch has shuffled is gone by then."""
    return cut_lineage(_importable(t).drop(*left_out))


@register
def resolve_accounts(t):
    return _resolved(t)


@register
def match_exact(t):
    rows = _importable_cut(t, "amount_cents", "payee", "notes")
    return matching.match_exact(rows, st.budget_transactions(t)).select("source_id", "source_key", "matched_id", "differs")


@register
def match_candidates(t):
    rows = _importable_cut(t, "imported_id", "notes")
    return matching.match_candidates(rows, matching.adoptable(st.budget_transactions(t))).select(
        "source_id", "source_key", "candidates", "best_id", "best_same_payee"
    )


@register
def match_assign(t):
    exact = matching.match_exact(_importable_cut(t, "notes"), st.budget_transactions(t)).where("matched_id is null")
    missing = cut_lineage(exact.select("source_id", "source_key", *matching.GROUP, "booking_date", "payee"))
    return matching.match_assign(missing, matching.adoptable(st.budget_transactions(t)))


@register
def import_plan(t):
    return importing.import_plan(_importable_cut(t), st.budget_transactions(t)).select(
        "source_id", "source_key", "action", "matched_id", "booking_date", "amount_cents", "payee", "notes"
    )


@register
def import_counts(t):
    parted = cut_lineage(_partitioned(t).select(
        "source_id", "source_key", "imported_id", "booking_date", "amount_cents", "counterpart_name", "posting_text", "purpose",
        "dedup_status",
    ))
    plan = importing.import_plan(importing.importable(parted, _resolved(t)), st.budget_transactions(t))
    return importing.import_counts(plan, parted)


# --- balances ---------------------------------------------------------------------------------


def _balances(t):
    return balances.account_balance(st.all_transactions(t), st.accounts(t))


@register
def account_balance(t):
    return _balances(t)


@register
def net_worth(t):
    return balances.net_worth(_balances(t))


@register
def reconciliation(t):
    return balances.reconciliation(st.sources(t), runs.latest_statement_balance(st.runs(t)), _balances(t))


def _openings(t):
    return balances.opening_balance(
        _resolved(t),
        runs.latest_statement_balance(st.runs(t)),
        ledger.earliest_booking(st.ledger_before(t)),
        _balances(t),
        st.openings(t),
    )


@register
def opening_balance(t):
    return _openings(t).drop("opening_id", "imported_id", "off_budget", "account_id")


@register
def starting_balance(t):
    """Balances after the opening rows are written."""
    after = balances.apply_opening(st.all_transactions(t), _openings(t))
    return balances.account_balance(after, st.accounts(t))


# --- rules, candidates, examples --------------------------------------------------------------


def _uncategorised(t):
    return rules.uncategorized(st.booked_transactions(t), st.payees(t), st.accounts(t))


@register
def uncategorized_txn(t):
    return _uncategorised(t).select("id", "account_id", "payee", "booking_date", "amount_cents")


@register
def categories(t):
    return candidates.visible_categories(st.categories(t), st.category_groups(t))


@register
def candidate_snippets(t):
    return candidates.snippets(_uncategorised(t)).select("payee", "snippet")


def _excluded(t):
    return candidates.excluded_payees(st.proposals_before(t))


def _shortlist(t):
    return candidates.candidates(_uncategorised(t), _excluded(t))


@register
def categorization_candidates(t):
    return _shortlist(t).withColumn("snippets", F.array_join("snippets", " | "))


def _category_refs(t):
    return candidates.category_refs(candidates.visible_categories(st.categories(t), st.category_groups(t)))


@register
def context_refs(t):
    people = candidates.candidate_refs(_shortlist(t)).select("ref", F.col("payee").alias("name"))
    return people.unionByName(_category_refs(t).select("ref", "name"))


def _taught(t):
    return rules.rule_examples(st.rules(t), st.payees(t), st.categories(t))


@register
def rule_examples(t):
    return _taught(t).select("payee", "category")


def _history(t):
    return candidates.history_examples(st.booked_transactions(t), st.payees(t), st.categories(t), _taught(t))


@register
def history_examples(t):
    return _history(t)


def _examples(t):
    return candidates.categorization_examples(_taught(t), _history(t))


@register
def categorization_examples(t):
    return _examples(t).withColumn("position", F.col("position").cast("bigint"))


@register
def apply_rules(t):
    return rules.apply_rules(_uncategorised(t), st.rules(t)).select("id", "payee_id", "new_category_id")


@register
def apply_rules_all(t):
    applied = rules.apply_rules(rules.live(st.booked_transactions(t)), st.rules(t))
    return applied.groupBy("new_category_id").agg(F.count(F.lit(1)).alias("transactions"))


@register
def apply_rules_stats(t):
    return rules.apply_stats(rules.apply_rules(_uncategorised(t), st.rules(t)), st.rules(t))


# --- proposals --------------------------------------------------------------------------------


def _offered(t):
    return proposals.read_proposals(st.raw_proposals(t))


def _context(t):
    others = candidates.candidates(_uncategorised(t), _excluded(t).limit(0), limit=None)
    return cut_lineage(proposals.with_others(candidates.candidate_refs(_shortlist(t)), others))


def _proposals(t):
    context = _context(t)
    return proposals.validate(proposals.resolve(_offered(t), context, _category_refs(t)), context, "m1")


@register
def validate_proposals(t):
    return _proposals(t).select(
        "payee", "category", F.col("confidence").cast("string").alias("confidence"), "reason",
        "tx_count", "avg_amount_cents", F.array_join("snippets", " | ").alias("snippets"), "model",
    )


@register
def drop_reasons(t):
    return proposals.drop_reasons(proposals.resolve(_offered(t), _context(t), _category_refs(t)))


@st.stored
def _queue(t):
    """The review queue as a stored table."""
    return _stored(t)


def _stored(t):
    return proposals.store(st.proposals_before(t), _proposals(t), "run1", _restart())


@register
def proposal_upsert(t):
    return _stored(t).select(
        "id", "payee", "category", F.col("confidence").cast("string").alias("confidence"), "reason",
        "tx_count", "avg_amount_cents", F.array_join("snippets", " | ").alias("snippets"), "model",
        "status", moment("created_at", "created"),
    )


@register
def proposal_list(t):
    return proposals.listing(_queue(t)).select(
        "short_id", "payee", "category", F.col("confidence").cast("string").alias("confidence"), "tx_count", "status"
    )


def _approved(t):
    chosen = proposals.select_proposals(_queue(t), ["a", "3f"], min_confidence=0.9)
    return rules.new_rules(chosen.select("id", "payee", "category"), st.payees(t), st.categories(t))


@register
def approve_selection(t):
    return _approved(t).select("id", "payee", "category", "payee_id", "category_id", "rule_id", "error")


@register
def rule_backfill(t):
    return rules.rule_backfill(_uncategorised(t), _approved(t)).select("id", "payee_id", "new_category_id", "rule_id")


@register
def approve_decide(t):
    made = _approved(t).where("error is null").select("id", "rule_id")
    return proposals.decide(_queue(t), made, proposals.APPROVED, _restart()).select("id", "payee", "status", "rule_id")


@register
def reject_selection(t):
    chosen = proposals.select_proposals(_queue(t), ["0", "c"])
    made = chosen.select("id", F.lit(None).cast("string").alias("rule_id"))
    return proposals.decide(_queue(t), made, proposals.REJECTED, _restart()).select("id", "payee", "status", "rule_id")


@register
def prompt_dataset(t):
    lines = prompts.prompt_lines(
        _category_refs(t), _examples(t), candidates.candidate_refs(_shortlist(t))
    )
    return prompts.prompt(lines)


@register
def prompt_enums(t):
    return prompts.allowed_values(_category_refs(t))


# --- summary ----------------------------------------------------------------------------------


def _summary(t, section):
    return reports.summary(
        st.sources(t), st.all_transactions(t), st.accounts(t), st.ledger_before(t), st.runs(t), st.proposals_before(t)
    )[section]


@register
def summary_accounts(t):
    return _summary(t, "accounts")


@register
def summary_net_worth(t):
    return _summary(t, "net_worth")


@register
def summary_ledger_rows(t):
    return _summary(t, "ledger_rows")


@register
def summary_reconciliation(t):
    return _summary(t, "reconciliation")


@register
def summary_proposals(t):
    return _summary(t, "proposals_pending").withColumn("confidence", F.col("confidence").cast("string"))


@register
def summary_runs(t):
    return _summary(t, "recent_runs")


# --- statement files --------------------------------------------------------------------------


def _parsed(t):
    formats = profiles.resolve_profiles(st.every_source(t).drop("r_name"), profiles.profiles_frame(t.spark))
    return statements.ParsedStatements(st.statement_lines(t), formats)


@register
def profile_resolve(t):
    resolved = profiles.resolve_profiles(st.sources(t), profiles.profiles_frame(t.spark))
    return resolved.select(
        "source_id", "format", "marker", F.element_at("columns", F.lit("purpose")).alias("purpose_header"),
        F.size("columns").alias("fields"), "decimal_comma", "config_error",
    )


@register
def doc_encoding(t):
    return _parsed(t).documents.select("source_id", "doc", "encoding", "error")


@register
def header_discovery(t):
    return _parsed(t).documents.where("header is not null").select(
        "source_id", "doc", F.col("header_at.line_no").alias("header_line"), F.size("header").alias("columns"),
        F.col("positions.purpose").alias("purpose_at"),
    )


@register
def statement_balance_parse(t):
    return _parsed(t).balances


@register
def canonical_rows(t):
    return _parsed(t).rows.drop("block")


@register
def doc_stats(t):
    return _parsed(t).stats.select(
        "source_id", "doc", "encoding", "rows", "pending_rows", "skipped_rows", "last_booking", "error"
    )


@register
def newest_statement_balance(t):
    return fetch.newest_statement_balance(_parsed(t).stats)


@register
def statement_inspect(t):
    return statements.inspect_rows(_parsed(t).rows)


# --- scalars ----------------------------------------------------------------------------------


@register
def parse_amount(t):
    value = st.cents(F.col("l_extendedprice"))
    signed = F.when(F.col("l_returnflag") == "R", -value).otherwise(value)
    german, dotted = st._german(st._money(signed)), F.format_number(st._money(signed), 2)
    third = F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linestatus") == "F", ",125").otherwise(",135"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        parsing.parse_amount(F.concat(german, F.lit(" EUR ")), True).alias("german"),
        parsing.parse_amount(F.concat(F.lit(" € "), dotted), False).alias("dotted"),
        parsing.parse_amount(third, True).alias("tie"),
        parsing.parse_amount(F.concat(F.lit("EUR "), F.repeat(F.lit(" "), 3)), True).alias("empty"),
        parsing.amount_error(F.concat(german, F.lit("?")), True).alias("broken"),
    )


@register
def parse_date(t):
    day = F.to_date("o_orderdate")
    both = ["%d.%m.%Y", "%Y-%m-%d"]
    return t.orders.select(
        "o_orderkey",
        parsing.parse_date(F.concat(F.lit(" "), F.date_format(day, "d.M.yyyy")), both).alias("german"),
        parsing.parse_date(day.cast("string"), both).alias("iso"),
        parsing.parse_date(F.concat(F.lit("31."), F.date_format(day, "MM.yyyy")), both).alias("day31"),
        parsing.parse_date("o_orderpriority", both).alias("text"),
    )


@register
def signed_amount(t):
    value = st.cents(F.col("l_extendedprice"))
    kind = F.col("l_returnflag")
    credit = F.when(kind == "A", value).when(kind == "R", F.lit(0))
    debit = F.when(kind == "R", value)
    other = F.when((kind == "N") & (F.col("l_linestatus") == "O"), -value)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", parsing.signed_amount(credit, debit, other).alias("amount_cents")
    )


@register
def norm_text(t):
    return t.documents.select("doc_id", F.sha2(text.norm("text"), 256).alias("normed")).unionByName(
        t.conversations.select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.sha2(text.norm("text"), 256).alias("normed")
        )
    )


@register
def loose_key(t):
    return t.documents.select("doc_id", F.sha2(text.loose_key("text"), 256).alias("loose"))


def _with_iban(t):
    iban = F.concat(F.lit("DE"), F.lpad(st.text("doc_id"), 20, "0"))
    return t.documents.withColumn("iban", iban).withColumn(
        "full", F.concat(F.lit("an "), "iban", F.lit(" von "), "text", F.lit(" und "), "iban")
    )


@register
def mask_text(t):
    return _with_iban(t).select("doc_id", F.sha2(masking.mask_text("full"), 256).alias("masked"))


@register
def mask_iban(t):
    grouped = F.regexp_replace("counterpart_iban", "(.{4})", "$1 ")
    short = F.substring("counterpart_iban", 1, 5)
    return st.statement_rows(t).select(
        "source_id", "doc", "row_no", masking.mask_iban(grouped).alias("masked"),
        masking.mask_iban(short).alias("short"), masking.mask_iban("end_to_end_id").alias("reference"),
    )


@register
def mask_snippet(t):
    return t.documents.select("doc_id", masking.mask_snippet("text").alias("snippet")).unionByName(
        t.conversations.select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), masking.mask_snippet("text").alias("snippet")
        )
    )


@register
def confidence(t):
    return t.events.select(
        "event_id",
        proposals.clamp_confidence(st.cents(F.col("value")) / 1000).alias("confidence"),
        proposals.clamp_confidence("event_type").alias("word"),
    )


@register
def amount_direction(t):
    signed = st.cents(F.col("s_acctbal"))
    amount = parsing.cents_to_amount(signed)
    return t.supplier.select(
        "s_suppkey", amount.cast("string").alias("amount"), parsing.to_cents(amount).alias("back"),
        prompts.direction(signed).alias("direction"), prompts.whole_amount(signed).alias("whole")
    )


# --- files, whole jobs, streams ---------------------------------------------------------------


def _document_folder(df):
    # the files are named by the writer; their folder carries the document's name
    return df.withColumn("doc", F.regexp_extract("doc", "/doc=([^/]+)/", 1))


def _formats(t):
    return profiles.resolve_profiles(st.sources(t), profiles.profiles_frame(t.spark))


def _inbox_files(t):
    return inbox.source_files(inbox.inbox_files(t.spark, st.statement_inbox(t)), _formats(t))


@register
def inbox_scan(t):
    return _document_folder(_inbox_files(t)).select("source_id", "doc")


@register
def unprocessed_files(t):
    files = _inbox_files(t)
    done = files.where("doc rlike '/doc=199'")
    return _document_folder(inbox.unprocessed(files, done)).select("source_id", "doc")


@register
def summary_inbox(t):
    return reports.inbox_section(_formats(t), _inbox_files(t))


def _new_store(t, **tables):
    store = SnapshotStore(t.spark, f"{shared_folder(t.spark)}/state-{uuid.uuid4().hex}")
    filled = {
        name: df.unionByName(t.spark.createDataFrame([], TABLES[name]), allowMissingColumns=True)
        for name, df in tables.items()
    }
    store.write("start", filled)
    return store


@st.stored
def _file_rows(t):
    parsed = _parsed(t)
    return fetch.fetch_transactions(parsed.rows, parsed.long_documents())


def _import_job(t):
    """A job whose state holds an import of the documents before ``SEED_YEAR`` and one that was cut short.

    The bank wrote the bookings of January differently then; of the run that was cut short, the budget has the rows
    of November as they are and those of December a day later, and the ledger nothing.
    """
    rows = _file_rows(t)
    old, month = F.left("doc", F.lit(4)).cast("int") < SEED_YEAR, F.month("booking_date")
    at = F.lit(st.FIRST_IMPORT).cast("timestamp")
    known = rows.where(old).select(
        "source_id", "source_key", "imported_id", F.col("account_ref").alias("actual_account_id"), "booking_date", "amount_cents",
        F.when(month == 1, F.lit("earlier")).otherwise(F.col("raw_fingerprint")).alias("raw_fingerprint"),
        F.lit("run0").alias("first_run_id"), F.lit("run0").alias("last_run_id"), at.alias("first_seen_at"), at.alias("last_seen_at"),
    )
    booked = rows.where(old | month.isin(11, 12)).select(
        F.sha2(F.concat_ws("/", "source_id", "source_key"), 256).alias("id"), F.col("account_ref").alias("account_id"),
        F.when(~old & (month == 12), F.date_add("booking_date", 1)).otherwise(F.col("booking_date")).alias("booking_date"),
        "amount_cents", identity.payee_name().alias("imported_payee"), F.left("purpose", F.lit(500)).alias("notes"), "imported_id",
        F.lit(True).alias("cleared"), F.lit(False).alias("is_parent"), F.lit(False).alias("tombstone"),
        F.lit(False).alias("starting_balance_flag"),
    )
    store = _new_store(
        t, account=st.accounts(t), payee=st.payees(t).drop("position"), rule=st.rules(t), import_ledger=known, budget_txn=booked,
    )
    return ImportJob(t.spark, st.statement_inbox(t), st.sources(t), store)


@register
def full_import(t):
    """Files to budget store and ledger, for all sources."""
    return _import_job(t).run("run1", st.THIS_IMPORT).select(
        "source_id", "account", "status", "error", "files", "fetched", "pending_rows", "new_rows", "changed_rows",
        "unchanged_rows", "added", "updated", "unchanged", "window_from", "window_to", "statement_balance_cents",
        "actual_balance_cents",
    )


@register
def stream_import(t):
    """The same by the stream, some files per micro-batch; the ledger of the sources of which no file waits."""
    job = _import_job(t)
    query = inbox_stream.start(job, f"{job.store.root}/checkpoint", lambda batch: st.THIS_IMPORT, files_per_batch=STREAM_FILES)
    query.awaitTermination()
    waiting = job.store.read("waiting_files").select("source_id")
    return ledger.ledger_size(job.store.read("import_ledger")).join(waiting, "source_id", "left_anti")


@register
def stream_distinct_events(t):
    """First delivery per user, kind and day."""
    folder = f"{shared_folder(t.spark)}/events-{uuid.uuid4().hex}"
    events = (
        t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    )
    keyed = events.select("user_id", "event_type", F.to_date("ts").alias("day"))
    query = (
        inbox_stream.distinct_events(keyed, ["user_id", "event_type", "day"])
        .writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return t.spark.read.schema(keyed.schema).parquet(f"{folder}/rows")


@register
def categorization_round(t):
    """Answers stored, the best approved: the review queue afterwards."""
    store = _new_store(
        t, account=st.accounts(t), payee=st.payees(t).drop("position"), rule=st.rules(t), category=st.categories(t),
        category_group=st.category_groups(t), budget_txn=st.booked_transactions(t), category_proposal=st.proposals_before(t),
    )
    at = datetime(2024, 1, 20)
    ReviewRound(store, "run1", at, "m1").store_answers(st.raw_proposals(t))
    ReviewRound(store, "run2", at).approve(["a", "3f"], min_confidence=0.9)
    return store.read("category_proposal").select("id", "payee", "status", "rule_id")
