"""Column layouts of the persistent tables and of the records that travel between the jobs."""

from __future__ import annotations

RAW_TXN = """
  source_id string, account_ref string, doc string, block bigint, row_no bigint,
  booking_date date, value_date date, amount_cents bigint, currency string,
  counterpart_name string, counterpart_iban string, purpose string, posting_text string,
  bank_reference string, end_to_end_id string, pending boolean
"""

# content columns of a row, carried through keying and merging
TXN_CONTENT = [
    "booking_date",
    "value_date",
    "amount_cents",
    "currency",
    "counterpart_name",
    "counterpart_iban",
    "purpose",
    "posting_text",
    "bank_reference",
    "end_to_end_id",
]

SOURCE = """
  id string, connector string, actual_account string, account_ref string, currency string,
  format string, inbox_glob string, format_overrides map<string,string>
"""

LEDGER = """
  source_id string, source_key string, imported_id string, actual_account_id string,
  booking_date date, amount_cents bigint, raw_fingerprint string, first_run_id string,
  last_run_id string, first_seen_at timestamp, last_seen_at timestamp
"""

RUN = """
  id string, source_id string, started_at timestamp, finished_at timestamp, window_from date,
  window_to date, fetched bigint, new_rows bigint, updated_rows bigint, unchanged_rows bigint,
  pending_rows bigint, status string, error string, trigger_source string,
  statement_balance_cents bigint, statement_balance_date date, actual_balance_cents bigint
"""

PROPOSAL = """
  id string, payee string, category string, confidence decimal(4,3), reason string,
  tx_count bigint, avg_amount_cents bigint, snippets array<string>, model string, status string,
  created_at timestamp, decided_at timestamp, rule_id string
"""

RAW_PROPOSALS = (
    "proposals array<struct<ref:string,payee:string,category_ref:string,"
    "category:string,confidence:string,reason:string>>"
)

BUDGET_TXN = """
  id string, account_id string, booking_date date, amount_cents bigint, payee_id string,
  imported_payee string, category_id string, notes string, imported_id string, cleared boolean,
  is_parent boolean, tombstone boolean, starting_balance_flag boolean
"""

ACCOUNT = "id string, name string, off_budget boolean, closed boolean"
PAYEE = "id string, name string, transfer_acct string, tombstone boolean"
CATEGORY = "id string, name string, group_id string, hidden boolean, tombstone boolean"
CATEGORY_GROUP = "id string, name string, tombstone boolean"
RULE = "id string, rule_order bigint, conditions string, actions string, tombstone boolean"
PROCESSED_FILE = "source_id string, doc string, modified_at timestamp, run_id string"
# files that arrived while their source could not be imported
WAITING_FILE = "source_id string, doc string, modified_at timestamp"

TABLES = {
    "import_ledger": LEDGER,
    "import_run": RUN,
    "category_proposal": PROPOSAL,
    "budget_txn": BUDGET_TXN,
    "account": ACCOUNT,
    "payee": PAYEE,
    "category": CATEGORY,
    "category_group": CATEGORY_GROUP,
    "rule": RULE,
    "processed_files": PROCESSED_FILE,
    "waiting_files": WAITING_FILE,
}
