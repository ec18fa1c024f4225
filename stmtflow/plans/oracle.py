"""ANSI SQL twins of the registered queries, for a side-by-side check on the same tables."""

from __future__ import annotations

# building blocks: name -> (SQL, names it needs)
_VIEWS: dict[str, tuple[str, list[str]]] = {}


RECURSIVE = {"walk"}


def view(name: str, sql: str, *needs: str) -> None:
    _VIEWS[name] = (sql.strip(), list(needs))


def query(sql: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in _VIEWS[name][1]:
            visit(need)
        order.append(name)

    for need in needs:
        visit(need)
    if not order:
        return sql.strip()
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({_VIEWS[n][0]})" for n in order) + "\n" + sql.strip()


def norm(x: str) -> str:
    return f"upper(trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g')))"


CONTENT = (
    "booking_date, value_date, amount_cents, currency, counterpart_name, counterpart_iban, "
    "purpose, posting_text, bank_reference, end_to_end_id"
)

view(
    "stmt",
    """
    SELECT 'src' || s_nationkey AS source_id, 'acct' || s_nationkey AS account_ref, doc,
      l_orderkey * 8 + l_linenumber AS row_no,
      CAST(l_shipdate AS DATE) AS booking_date,
      CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) + 1 END AS value_date,
      CAST((CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END) * (floor(l_quantity / 5) * 500 + 500) AS BIGINT) AS amount_cents,
      CASE WHEN l_linestatus = 'F' THEN 'EUR' ELSE 'eur' END AS currency,
      s_name AS counterpart_name,
      'DE00 5001 ' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') || ' 11' AS counterpart_iban,
      CASE WHEN doc = 'b.csv' AND l_returnflag = 'A' THEN '  delivery  from WAREHOUSE ' ELSE 'Delivery from warehouse' END AS purpose,
      CASE WHEN l_returnflag = 'R' THEN 'Gutschrift' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'Vorgemerkt Lastschrift' ELSE 'SEPA-Lastschrift' END AS posting_text,
      CASE WHEN l_returnflag = 'R' THEN 'R' || l_orderkey END AS bank_reference,
      CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'E2E-' || l_orderkey END AS end_to_end_id,
      (l_returnflag = 'N' AND l_linestatus = 'O') AS pending, l_linestatus
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
      JOIN (VALUES ('a.csv', DATE '1900-01-01', DATE '2000-01-01'), ('b.csv', DATE '1998-01-01', DATE '2900-01-01')) e(doc, lo, hi)
        ON CAST(l_shipdate AS DATE) >= lo AND CAST(l_shipdate AS DATE) < hi
    """,
)


def _keyed(base: str) -> str:
    canon = (
        "concat_ws(chr(31), 'v1', account_ref, CAST(booking_date AS VARCHAR), CAST(amount_cents AS VARCHAR), upper(currency), "
        + ", ".join(
            norm(x)
            for x in (
                "coalesce(nullif(end_to_end_id, ''), bank_reference)",
                "counterpart_iban",
                "counterpart_name",
                "purpose",
                "posting_text",
            )
        )
        + ")"
    )
    return f"""
    SELECT source_id, account_ref, doc, ordinal, source_key, source_id || ':' || left(source_key, 32) AS imported_id,
      sha256(concat_ws(chr(31), CAST(booking_date AS VARCHAR), coalesce(CAST(value_date AS VARCHAR), ''),
        CAST(amount_cents AS VARCHAR), currency, coalesce(counterpart_name, ''), coalesce(counterpart_iban, ''), purpose,
        coalesce(posting_text, ''), coalesce(bank_reference, ''), coalesce(end_to_end_id, ''))) AS raw_fingerprint,
      booking_date, value_date, amount_cents, upper(currency) AS currency, counterpart_name, counterpart_iban, purpose,
      posting_text, bank_reference, end_to_end_id
    FROM (
      SELECT *, sha256(ctext || chr(31) || CAST(ordinal AS VARCHAR)) AS source_key
      FROM (
        SELECT *, row_number() OVER (PARTITION BY source_id, doc, ctext ORDER BY row_no) - 1 AS ordinal
        FROM (SELECT *, {canon} AS ctext FROM {base} WHERE NOT pending)
      )
    )
    """


view("keyed", _keyed("stmt"), "stmt")
view(
    "merged",
    """SELECT * FROM keyed
    QUALIFY row_number() OVER (PARTITION BY source_id, source_key ORDER BY doc) = 1""",
    "keyed",
)
view(
    "stmt_before",
    """SELECT * REPLACE (CASE WHEN l_linestatus = 'F' THEN upper(purpose) ELSE purpose END AS purpose)
    FROM stmt WHERE doc = 'a.csv'""",
    "stmt",
)
view("keyed_before", _keyed("stmt_before"), "stmt_before")
view(
    "ledger0",
    """SELECT source_id, source_key, imported_id, account_ref AS actual_account_id, booking_date, amount_cents,
      raw_fingerprint, 'run0' AS first_run_id, 'run0' AS last_run_id,
      TIMESTAMP '2000-01-02' AS first_seen_at, TIMESTAMP '2000-01-02' AS last_seen_at
    FROM keyed_before""",
    "keyed_before",
)
view(
    "parted",
    """SELECT m.*, CASE WHEN l.raw_fingerprint IS NULL THEN 'new'
      WHEN l.raw_fingerprint <> m.raw_fingerprint THEN 'changed' ELSE 'unchanged' END AS dedup_status
    FROM merged m LEFT JOIN ledger0 l USING (source_id, source_key)""",
    "merged",
    "ledger0",
)
view(
    "every_source",
    """SELECT 'src' || n_nationkey AS id, 'manual_import' AS connector, n_name AS actual_account,
      'acct' || n_nationkey AS account_ref, 'EUR' AS currency,
      CASE WHEN r_name NOT IN ('AFRICA', 'MIDDLE EAST') THEN 'postbank-csv' ELSE 'generic-csv' END AS format,
      'source_id=src' || n_nationkey || '/*/*.txt' AS inbox_glob, r_name
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
view("sources", "SELECT * FROM every_source WHERE r_name <> 'MIDDLE EAST'", "every_source")
view(
    "accounts",
    """SELECT 'acct' || n_nationkey AS id, n_name AS name, r_name = 'ASIA' AS off_budget, n_name = 'NATION_24' AS closed
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
view(
    "runs",
    """SELECT 'run' || event_id AS id, 'src' || (user_id % 25) AS source_id, ts AS started_at,
      CASE WHEN event_type <> 'view' THEN ts + INTERVAL 1 MINUTE END AS finished_at,
      CAST(ts AS DATE) - 30 AS window_from, CAST(ts AS DATE) AS window_to,
      CAST(round(value * 100) AS BIGINT) AS fetched,
      CASE WHEN event_type IN ('click', 'purchase') THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END AS new_rows,
      CASE event_type WHEN 'click' THEN 'ok' WHEN 'purchase' THEN 'ok' WHEN 'view' THEN 'fetched'
        WHEN 'signup' THEN 'abandoned' ELSE 'error' END AS status,
      CASE WHEN event_type = 'error' THEN 'cannot parse amount' END AS error,
      CASE WHEN event_type = 'purchase' THEN 'api' ELSE 'cli' END AS trigger_source,
      CASE WHEN event_type IN ('click', 'error', 'purchase') THEN CAST(round(value * 100) AS BIGINT) * 100 END AS statement_balance_cents,
      CASE WHEN event_type = 'click' THEN CAST(ts AS DATE) END AS statement_balance_date,
      CASE WHEN event_type IN ('click', 'signup') THEN CAST(round(value * 100) AS BIGINT) * 100 - user_id END AS actual_balance_cents
    FROM events""",
)

QUERIES: dict[str, str] = {}


def register(name: str, sql: str, *needs: str) -> None:
    QUERIES[name] = query(sql, *needs)


register(
    "assign_keys",
    "SELECT source_id, doc, ordinal, source_key, imported_id, raw_fingerprint, booking_date, amount_cents, currency FROM keyed",
    "keyed",
)
register(
    "fingerprint",
    "SELECT source_id, doc, source_key, raw_fingerprint FROM keyed",
    "keyed",
)
register(
    "merge_documents",
    f"SELECT source_id, source_key, doc, imported_id, raw_fingerprint, {CONTENT} FROM merged",
    "merged",
)
register(
    "ledger_partition",
    "SELECT source_id, source_key, imported_id, booking_date, amount_cents, dedup_status FROM parted",
    "parted",
)
register(
    "partition_counts",
    """SELECT source_id, count(*) FILTER (dedup_status = 'new') AS new_rows, count(*) FILTER (dedup_status = 'changed') AS changed_rows,
      count(*) FILTER (dedup_status = 'unchanged') AS unchanged_rows FROM parted GROUP BY source_id""",
    "parted",
)
register(
    "pending_split",
    """SELECT source_id, doc, count(*) FILTER (NOT pending) AS booked_rows, count(*) FILTER (pending) AS pending_rows
    FROM stmt GROUP BY source_id, doc""",
    "stmt",
)
register(
    "fetch_stats",
    """SELECT f.source_id, coalesce(fetched, 0) AS fetched, pending_rows, files, window_from, window_to
    FROM (SELECT source_id, count(DISTINCT doc) AS files, count(*) FILTER (pending) AS pending_rows FROM stmt GROUP BY source_id) f
    LEFT JOIN (SELECT source_id, count(*) AS fetched, min(booking_date) AS window_from, max(booking_date) AS window_to FROM merged GROUP BY source_id) m
    USING (source_id)""",
    "stmt",
    "merged",
)
register(
    "payee_name",
    """SELECT source_id, source_key, trim(coalesce(nullif(counterpart_name, ''), nullif(posting_text, ''), 'Unknown payee')) AS payee_name
    FROM merged""",
    "merged",
)
register("earliest_booking", "SELECT source_id, min(booking_date) AS earliest_booking FROM ledger0 GROUP BY source_id", "ledger0")
register("ledger_size", "SELECT source_id, count(*) AS ledger_rows FROM ledger0 GROUP BY source_id", "ledger0")
register(
    "orphan_sources",
    "SELECT DISTINCT source_id FROM ledger0 WHERE source_id NOT IN (SELECT id FROM sources)",
    "ledger0",
    "sources",
)
register(
    "ledger_record",
    """SELECT coalesce(l.source_id, p.source_id) AS source_id, coalesce(l.source_key, p.source_key) AS source_key,
      coalesce(l.imported_id, p.imported_id) AS imported_id, coalesce(l.actual_account_id, s.account_ref) AS actual_account_id,
      CASE WHEN dedup_status IN ('new', 'changed') THEN p.booking_date ELSE l.booking_date END AS booking_date,
      CASE WHEN dedup_status IN ('new', 'changed') THEN p.amount_cents ELSE l.amount_cents END AS amount_cents,
      CASE WHEN dedup_status IN ('new', 'changed') THEN p.raw_fingerprint ELSE l.raw_fingerprint END AS raw_fingerprint,
      coalesce(l.first_run_id, 'run1') AS first_run_id,
      CASE WHEN dedup_status IS NOT NULL THEN 'run1' ELSE l.last_run_id END AS last_run_id,
      CAST(CAST(coalesce(l.first_seen_at, TIMESTAMP '2002-01-01') AS DATE) AS VARCHAR) AS first_seen,
      CAST(CAST(CASE WHEN dedup_status IS NOT NULL THEN TIMESTAMP '2002-01-01' ELSE l.last_seen_at END AS DATE) AS VARCHAR) AS last_seen
    FROM ledger0 l FULL JOIN (SELECT * FROM parted WHERE dedup_status IN ('new', 'changed')) p
      ON l.source_id = p.source_id AND l.source_key = p.source_key
      LEFT JOIN (SELECT DISTINCT source_id, account_ref FROM merged) s ON s.source_id = p.source_id""",
    "parted",
)
register(
    "ledger_touch",
    """SELECT l.source_id, l.source_key, CASE WHEN p.source_key IS NOT NULL THEN 'run1' ELSE l.last_run_id END AS last_run_id,
      CASE WHEN p.source_key IS NOT NULL THEN '2002-01-01' ELSE CAST(CAST(l.last_seen_at AS DATE) AS VARCHAR) END AS last_seen
    FROM ledger0 l LEFT JOIN (SELECT source_id, source_key FROM parted WHERE dedup_status = 'unchanged') p
      ON l.source_id = p.source_id AND l.source_key = p.source_key""",
    "parted",
)
register("forget_source", "SELECT source_id, source_key FROM ledger0 WHERE source_id NOT IN ('src3', 'src7')", "ledger0")


def _at(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


_RUN_STATE = "id, source_id, status, error, statement_balance_cents"
register(
    "run_log",
    f"SELECT {_RUN_STATE}, {_at("finished_at")} AS finished FROM runs",
    "runs",
)
register(
    "abandon_runs",
    """SELECT id, source_id, CASE WHEN status = 'fetched' THEN 'abandoned' ELSE status END AS status,
      CASE WHEN status = 'fetched' THEN 'pipeline restarted before import' ELSE error END AS error,
      CASE WHEN status = 'fetched' THEN '2024-01-20 00:00:00.000000' ELSE strftime(finished_at, '%Y-%m-%d %H:%M:%S.%f') END AS finished FROM runs""",
    "runs",
)
_LATE = "status = 'fetched' AND TIMESTAMP '2024-01-20' > started_at + INTERVAL 3600 SECOND"
register(
    "expire_runs",
    f"""SELECT id, source_id, CASE WHEN {_LATE} THEN 'abandoned' ELSE status END AS status,
      CASE WHEN {_LATE} THEN 'batch expired before import' ELSE error END AS error,
      CASE WHEN {_LATE} THEN '2024-01-20 00:00:00.000000' ELSE {_at("finished_at")} END AS finished FROM runs""",
    "runs",
)
view(
    "latest_balance",
    """SELECT source_id, statement_balance_cents, statement_balance_date, started_at FROM runs
    WHERE status = 'ok' AND statement_balance_cents IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) = 1""",
    "runs",
)
register(
    "latest_statement_balance",
    f"SELECT source_id, statement_balance_cents, statement_balance_date, {_at('started_at')} AS seen FROM latest_balance",
    "latest_balance",
)
register(
    "recent_runs",
    f"SELECT {_RUN_STATE} FROM runs ORDER BY started_at DESC, id DESC LIMIT 10",
    "runs",
)
register(
    "source_status",
    """SELECT s.id AS source_id, connector, format, actual_account, coalesce(n, 0) AS ledger_rows, last_run_at, r.status AS last_run_status
    FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n FROM ledger0 GROUP BY source_id) l ON l.source_id = s.id
    LEFT JOIN (SELECT source_id, strftime(started_at, '%Y-%m-%dT%H:%M') AS last_run_at, status
      FROM runs
      QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) = 1) r ON r.source_id = s.id""",
    "sources",
    "ledger0",
    "runs",
)
register(
    "balance_drift",
    "SELECT id, source_id, actual_balance_cents - statement_balance_cents AS balance_delta_cents FROM runs",
    "runs",
)
register(
    "source_lookup",
    """SELECT e.source_id, actual_account, account_ref, format, CASE WHEN s.id IS NULL THEN 'unknown source ' || e.source_id END AS error
    FROM (SELECT DISTINCT source_id FROM runs) e LEFT JOIN sources s ON s.id = e.source_id""",
    "runs",
    "sources",
)

# --- matching and import ----------------------------------------------------------------------

view(
    "resolved",
    """SELECT s.id AS source_id, s.actual_account, a.id AS account_id, a.off_budget,
      CASE WHEN a.id IS NULL THEN 'no account named ' || s.actual_account END AS error
    FROM sources s LEFT JOIN accounts a ON a.name = s.actual_account""",
    "sources",
    "accounts",
)
view(
    "importable",
    """SELECT source_id, source_key, account_id, imported_id, booking_date, amount_cents,
      trim(coalesce(nullif(counterpart_name, ''), nullif(posting_text, ''), 'Unknown payee')) AS payee, left(purpose, 500) AS notes
    FROM parted JOIN resolved USING (source_id) WHERE dedup_status = 'new' AND error IS NULL""",
    "parted",
    "resolved",
)
view(
    "budget",
    """SELECT sha256(source_id || '/' || source_key) AS id, account_ref AS account_id,
      CASE WHEN own AND weekend THEN booking_date + 2 WHEN own THEN booking_date
        ELSE booking_date + CAST(day(booking_date) % 7 - 3 AS INTEGER) END AS booking_date,
      amount_cents, CASE WHEN own OR NOT weekend THEN counterpart_name END AS payee,
      CASE WHEN own THEN purpose END AS notes,
      CASE WHEN own THEN imported_id WHEN month(booking_date) = 12 THEN 'other:' || source_key END AS imported_id,
      own AND NOT weekend AS cleared
    FROM (SELECT *, doc = 'a.csv' OR (quarter(booking_date) <= 2 AND amount_cents > 0) AS own,
        dayofweek(booking_date) IN (0, 6) AS weekend FROM merged)
    WHERE own OR quarter(booking_date) > 2""",
    "merged",
)
register("resolve_accounts", "SELECT * FROM resolved", "resolved")
register(
    "match_exact",
    """SELECT i.source_id, i.source_key, b.id AS matched_id,
      b.id IS NOT NULL AND (b.booking_date <> i.booking_date OR NOT b.cleared) AS differs
    FROM importable i LEFT JOIN budget b ON b.account_id = i.account_id AND b.imported_id = i.imported_id""",
    "importable",
    "budget",
)
view(
    "pairs",
    """SELECT i.source_id, i.source_key, b.id, abs(date_diff('day', i.booking_date, b.booking_date)) AS days,
      b.booking_date AS day, coalesce(b.payee = i.payee, false) AS same
    FROM importable i JOIN budget b ON b.account_id = i.account_id AND b.amount_cents = i.amount_cents
      AND b.booking_date BETWEEN i.booking_date - 7 AND i.booking_date + 7 AND b.imported_id IS NULL""",
    "importable",
    "budget",
)
register(
    "match_candidates",
    """SELECT i.source_id, i.source_key, coalesce(candidates, 0) AS candidates, best_id, coalesce(best_same_payee, false) AS best_same_payee
    FROM importable i LEFT JOIN (
      SELECT source_id, source_key, count(*) AS candidates,
        first(id ORDER BY same DESC, days, day, id) AS best_id, bool_or(same) AS best_same_payee
      FROM pairs GROUP BY source_id, source_key) p USING (source_id, source_key)""",
    "importable",
    "pairs",
)

view(
    "exact",
    """SELECT i.*, b.id AS matched_id, b.id IS NOT NULL AND (b.booking_date <> i.booking_date OR NOT b.cleared) AS differs
    FROM importable i LEFT JOIN budget b ON b.account_id = i.account_id AND b.imported_id = i.imported_id""",
    "importable",
    "budget",
)
# rows of each account and amount in the order of choice, with the ids they would take, best first
view(
    "choosers",
    """SELECT e.account_id, e.amount_cents, e.source_id, e.source_key, coalesce(prefs, []) AS prefs,
      row_number() OVER (PARTITION BY e.account_id, e.amount_cents ORDER BY e.source_id, e.booking_date, e.source_key) AS i
    FROM exact e LEFT JOIN (SELECT source_id, source_key, list(id ORDER BY same DESC, days, day, id) AS prefs FROM pairs GROUP BY ALL) p
      ON p.source_id = e.source_id AND p.source_key = e.source_key WHERE matched_id IS NULL""",
    "exact",
    "pairs",
)
view(
    "walk",
    """SELECT DISTINCT account_id, amount_cents, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS source_id,
      CAST(NULL AS VARCHAR) AS source_key, CAST(NULL AS VARCHAR) AS id FROM choosers
    UNION ALL
    SELECT account_id, amount_cents, i, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, source_id, source_key, pick
    FROM (SELECT c.account_id, c.amount_cents, c.i, w.used, c.source_id, c.source_key,
        list_filter(c.prefs, lambda x: NOT list_contains(w.used, x))[1] AS pick
      FROM walk w JOIN choosers c ON c.account_id = w.account_id AND c.amount_cents = w.amount_cents AND c.i = w.i + 1)""",
    "choosers",
)
register("match_assign", "SELECT source_id, source_key, id FROM walk WHERE id IS NOT NULL", "walk")
view(
    "plan",
    """SELECT e.source_id, e.source_key, e.booking_date, e.amount_cents, e.payee, e.notes, coalesce(e.matched_id, w.id) AS matched_id,
      CASE WHEN e.matched_id IS NOT NULL THEN CASE WHEN differs THEN 'updated' ELSE 'unchanged' END
        WHEN w.id IS NOT NULL THEN 'adopted' ELSE 'created' END AS action
    FROM exact e LEFT JOIN (SELECT * FROM walk WHERE id IS NOT NULL) w ON w.source_id = e.source_id AND w.source_key = e.source_key""",
    "exact",
    "walk",
)
register("import_plan", "SELECT source_id, source_key, action, matched_id, booking_date, amount_cents, payee, notes FROM plan", "plan")
register(
    "import_counts",
    """SELECT k.source_id, coalesce(added, 0) AS added, coalesce(updated, 0) AS updated, known + coalesce(kept, 0) AS unchanged
    FROM (SELECT source_id, count(*) FILTER (dedup_status = 'unchanged') AS known FROM parted GROUP BY 1) k
    LEFT JOIN (SELECT source_id, count(*) FILTER (action = 'created') AS added, count(*) FILTER (action IN ('adopted', 'updated')) AS updated,
      count(*) FILTER (action = 'unchanged') AS kept FROM plan GROUP BY 1) p USING (source_id)""",
    "parted",
    "plan",
)

# --- budget store -----------------------------------------------------------------------------

view(
    "booked",
    """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id, 'acct' || s_nationkey AS account_id,
      CAST(l_shipdate AS DATE) AS booking_date,
      (CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END) * CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents,
      'payee' || l_suppkey AS payee_id, s_name || ' ' || p_type AS imported_payee,
      CASE WHEN l_returnflag <> 'N' THEN p_type || '/' || p_brand END AS category_id,
      'Order ' || l_orderkey || '  ' || p_name AS notes, l_linenumber = 7 AS is_parent, l_discount = 0 AS tombstone,
      l_tax > 0 AND l_tax = 0.08 AS starting_balance_flag, l_suppkey, s_nationkey, s_acctbal
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
)
view(
    "openings",
    """SELECT 'acct' || n_nationkey AS account_id, 'src' || n_nationkey AS source_id, DATE '1994-12-31' AS booking_date,
      CAST(n_nationkey * 1000 AS BIGINT) AS amount_cents
    FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AMERICA', 'EUROPE')""",
)
view(
    "balances",
    """SELECT a.id AS account_id, name, off_budget, CAST(coalesce(b, 0) AS BIGINT) AS balance_cents
    FROM accounts a LEFT JOIN (
      SELECT account_id, sum(amount_cents) AS b FROM (
        SELECT account_id, amount_cents FROM booked WHERE NOT tombstone AND NOT is_parent
        UNION ALL SELECT account_id, amount_cents FROM openings) GROUP BY account_id) t ON t.account_id = a.id
    WHERE NOT closed""",
    "accounts",
    "booked",
    "openings",
)
view(
    "worth",
    """SELECT CAST(sum(CASE WHEN NOT off_budget THEN balance_cents ELSE 0 END) AS BIGINT) AS on_budget_cents,
      CAST(sum(CASE WHEN off_budget THEN balance_cents ELSE 0 END) AS BIGINT) AS off_budget_cents,
      CAST(sum(balance_cents) AS BIGINT) AS net_worth_cents FROM balances""",
    "balances",
)
register("account_balance", "SELECT * FROM balances", "balances")
register("net_worth", "SELECT * FROM worth", "worth")
view(
    "reconciled",
    """SELECT s.id AS source_id, s.actual_account AS account, l.statement_balance_cents, l.statement_balance_date,
      b.balance_cents AS actual_balance_cents, b.balance_cents - l.statement_balance_cents AS delta_cents,
      b.balance_cents = l.statement_balance_cents AS reconciled
    FROM sources s JOIN latest_balance l ON l.source_id = s.id JOIN balances b ON b.name = s.actual_account""",
    "sources",
    "latest_balance",
    "balances",
)
register("reconciliation", "SELECT * FROM reconciled", "reconciled")
view(
    "opened",
    """SELECT r.source_id, r.actual_account AS account, r.account_id, l.statement_balance_cents, l.statement_balance_date,
      o.amount_cents AS previous, o.booking_date AS previous_date, e.earliest - 1 AS dated,
      coalesce(b.balance_cents, 0) - coalesce(o.amount_cents, 0) AS others,
      coalesce(r.error, CASE WHEN l.statement_balance_cents IS NULL THEN 'no statement balance known' END,
        CASE WHEN e.earliest IS NULL THEN 'nothing imported yet' END) AS error
    FROM resolved r LEFT JOIN latest_balance l USING (source_id)
      LEFT JOIN (SELECT source_id, min(booking_date) AS earliest FROM ledger0 GROUP BY source_id) e USING (source_id)
      LEFT JOIN balances b ON b.account_id = r.account_id
      LEFT JOIN openings o ON o.account_id = r.account_id AND o.source_id = r.source_id""",
    "resolved",
    "latest_balance",
    "ledger0",
    "balances",
    "openings",
)
register(
    "opening_balance",
    """SELECT source_id, account, CASE WHEN error IS NOT NULL THEN NULL WHEN previous IS NULL THEN 'created'
        WHEN previous = statement_balance_cents - others AND previous_date = dated THEN 'unchanged' ELSE 'updated' END AS action,
      CASE WHEN error IS NULL THEN dated END AS dated, statement_balance_cents, statement_balance_date,
      previous AS previous_starting_balance_cents,
      CASE WHEN error IS NULL THEN statement_balance_cents - others END AS starting_balance_cents,
      CASE WHEN error IS NULL THEN statement_balance_cents END AS account_balance_after_cents, error FROM opened""",
    "opened",
)
register(
    "starting_balance",
    """SELECT b.account_id, b.name, b.off_budget,
      CASE WHEN o.account_id IS NOT NULL AND o.error IS NULL THEN o.statement_balance_cents ELSE b.balance_cents END AS balance_cents
    FROM balances b LEFT JOIN opened o ON o.account_id = b.account_id""",
    "balances",
    "opened",
)

# --- rules, candidates, examples --------------------------------------------------------------

view(
    "payees",
    """SELECT 'payee' || s_suppkey AS id, 'Shop ' || (s_suppkey // 2) AS name, s_acctbal < 0 AS transfer FROM supplier""",
)
view(
    "cats",
    """SELECT DISTINCT p_type || '/' || p_brand AS id, p_brand || ' ' || p_type AS name, p_type AS group_id,
      p_brand = 'Brand#13' AS hidden, p_brand = 'Brand#25' AS tombstone FROM part""",
)
view(
    "uncategorised",
    """SELECT b.*, p.name AS payee FROM booked b JOIN payees p ON p.id = b.payee_id JOIN accounts a ON a.id = b.account_id
    WHERE NOT b.tombstone AND NOT b.is_parent AND b.category_id IS NULL AND NOT b.starting_balance_flag
      AND NOT a.closed AND NOT a.off_budget AND NOT p.transfer""",
    "booked",
    "payees",
    "accounts",
)
register("uncategorized_txn", "SELECT id, account_id, payee, booking_date, amount_cents FROM uncategorised", "uncategorised")
view(
    "visible",
    """SELECT name, CASE WHEN group_id = 'PROMO' THEN '' ELSE left(group_id, 1) || lower(substr(group_id, 2)) END AS "group"
    FROM cats WHERE NOT tombstone AND NOT hidden""",
    "cats",
)
register("categories", 'SELECT name, "group" FROM visible', "visible")
view(
    "snips",
    """SELECT payee, snippet, booking_date, id FROM (
      SELECT payee, left(trim(regexp_replace(regexp_replace(notes, '\\d{3,}', '#', 'g'), '\\s+', ' ', 'g')), 60) AS snippet, booking_date, id
      FROM uncategorised)
    WHERE snippet <> ''
    QUALIFY row_number() OVER (PARTITION BY payee, snippet ORDER BY booking_date, id) = 1""",
    "uncategorised",
)
view(
    "snips2",
    """SELECT payee, snippet, row_number() OVER (PARTITION BY payee ORDER BY booking_date, id) AS i FROM snips
    QUALIFY i <= 2""",
    "snips",
)
register("candidate_snippets", "SELECT payee, snippet FROM snips2", "snips2")
view(
    "state0",
    """SELECT md5(payee) AS id, payee, 'Brand#' || (n + 1) || ' LARGE' AS category,
      CAST(least(round(abs(v) / 10000, 3), 1.0) AS DECIMAL(4,3)) AS confidence, 'looks alike' AS reason,
      CASE WHEN n <> 7 THEN k END AS tx_count, CAST(round(v * 100) AS BIGINT) AS avg_amount_cents, payee AS snippets, 'm0' AS model,
      CASE WHEN n < 4 THEN 'rejected' WHEN n < 6 THEN 'approved' ELSE 'pending' END AS status,
      TIMESTAMP '2024-01-01' + to_minutes(n) AS created_at
    FROM (SELECT 'Shop ' || (s_suppkey // 2) AS payee, min(s_suppkey) AS k, min(s_nationkey) AS n, max(s_acctbal) AS v
      FROM supplier GROUP BY 1) WHERE n < 15""",
)
view(
    "every_candidate",
    """SELECT u.payee, tx_count, avg_amount_cents, coalesce(snippets, '') AS snippets FROM (
      SELECT payee, count(*) AS tx_count, CAST(sum(amount_cents) // count(*) AS BIGINT) AS avg_amount_cents
      FROM uncategorised GROUP BY payee) u
    LEFT JOIN (SELECT payee, string_agg(snippet, ' | ' ORDER BY i) AS snippets FROM snips2 GROUP BY payee) s USING (payee)""",
    "uncategorised",
    "snips2",
)
view(
    "shortlist",
    """SELECT *, 'p' || row_number() OVER (ORDER BY tx_count DESC, payee) AS ref FROM every_candidate
    WHERE payee NOT IN (SELECT payee FROM state0 WHERE status IN ('pending', 'rejected'))
    ORDER BY tx_count DESC, payee LIMIT 25""",
    "every_candidate",
    "state0",
)
register("categorization_candidates", "SELECT payee, tx_count, avg_amount_cents, snippets FROM shortlist", "shortlist")
view(
    "crefs",
    """SELECT name, "group", row_number() OVER (ORDER BY "group", name) AS position,
      'c' || row_number() OVER (ORDER BY "group", name) AS ref FROM visible""",
    "visible",
)
register(
    "context_refs",
    "SELECT ref, payee AS name FROM shortlist UNION ALL SELECT ref, name FROM crefs",
    "shortlist",
    "crefs",
)
# conditions of the rules, one row per rule, condition and payee or text
view(
    "conds",
    """SELECT s_suppkey AS rule_order, s_nationkey, 'ECONOMY/Brand#' || (s_nationkey + 1) AS category_id, size, position, item, payee_id, pattern
    FROM (
      SELECT *, 1 AS size, 0 AS position, 0 AS item, 'payee' || s_suppkey AS payee_id, NULL AS pattern FROM supplier WHERE s_nationkey < 6
      UNION ALL SELECT *, 1, 0, 0, 'payee' || (s_suppkey + 1), NULL FROM supplier WHERE s_nationkey BETWEEN 6 AND 11
      UNION ALL SELECT *, 1, 0, 1, 'payee' || s_suppkey, NULL FROM supplier WHERE s_nationkey BETWEEN 6 AND 11
      UNION ALL SELECT *, CASE WHEN s_nationkey < 18 THEN 1 ELSE 2 END, 0, 0, NULL, substr(s_name, 5, 20) || ' promo' FROM supplier WHERE s_nationkey BETWEEN 12 AND 21
      UNION ALL SELECT *, 2, 1, 0, 'payee' || s_suppkey, NULL FROM supplier WHERE s_nationkey BETWEEN 18 AND 21
    ) WHERE s_nationkey NOT IN (3, 5)""",
)
view(
    "taught",
    """SELECT n.payee, c.name AS category, rule_order, position, item FROM (
      SELECT p.name AS payee, conds.* FROM conds JOIN payees p ON p.id = conds.payee_id
      UNION ALL SELECT '*' || pattern || '*', conds.* FROM conds WHERE pattern IS NOT NULL) n
    JOIN cats c ON c.id = n.category_id AND NOT c.tombstone
    QUALIFY row_number() OVER (PARTITION BY n.payee ORDER BY rule_order, position, item) = 1""",
    "conds",
    "payees",
    "cats",
)
register("rule_examples", "SELECT payee, category FROM taught", "taught")
view(
    "history",
    """SELECT payee, category, tx_count FROM (
      SELECT p.name AS payee, c.name AS category, count(*) AS tx_count
      FROM booked b JOIN payees p ON p.id = b.payee_id JOIN cats c ON c.id = b.category_id AND NOT c.tombstone
      WHERE NOT b.tombstone AND NOT b.is_parent GROUP BY 1, 2)
    WHERE payee NOT IN (SELECT payee FROM taught)
    QUALIFY row_number() OVER (PARTITION BY payee ORDER BY tx_count DESC, category) = 1""",
    "booked",
    "payees",
    "cats",
    "taught",
)
register("history_examples", "SELECT * FROM history", "history")
view(
    "examples",
    """SELECT payee, category, source, position FROM (
      SELECT payee, category, source, row_number() OVER (ORDER BY kind, rule_order, position, item, tx_count DESC, payee, category) AS position FROM (
        SELECT payee, category, 'rule' AS source, 0 AS kind, rule_order, position, item, 0 AS tx_count FROM taught
        UNION ALL SELECT payee, category, 'history', 1, 0, 0, 0, tx_count FROM history))
    WHERE position <= 60""",
    "taught",
    "history",
)
register("categorization_examples", "SELECT * FROM examples", "examples")
view(
    "outcomes",
    """SELECT payee_id, imported_payee, first(category_id ORDER BY rule_order DESC) AS rule_category FROM (
      SELECT s.payee_id, s.imported_payee, rule_order, category_id, size, count(DISTINCT position) AS held
      FROM (SELECT DISTINCT payee_id, imported_payee FROM booked) s
        JOIN conds c ON c.payee_id = s.payee_id OR contains(lower(s.imported_payee), lower(c.pattern))
      GROUP BY ALL HAVING count(DISTINCT position) = size) GROUP BY 1, 2""",
    "booked",
    "conds",
)
register(
    "apply_rules",
    "SELECT id, payee_id, coalesce(rule_category, category_id) AS new_category_id FROM uncategorised LEFT JOIN outcomes USING (payee_id, imported_payee)",
    "uncategorised",
    "outcomes",
)
register(
    "apply_rules_all",
    """SELECT coalesce(rule_category, category_id) AS new_category_id, count(*) AS transactions
    FROM booked LEFT JOIN outcomes USING (payee_id, imported_payee) WHERE NOT tombstone AND NOT is_parent GROUP BY 1""",
    "booked",
    "outcomes",
)
register(
    "apply_rules_stats",
    """SELECT count(*) AS considered, count(rule_category) AS categorized,
      (SELECT count(*) FROM supplier WHERE s_nationkey <> 5) AS rules
    FROM uncategorised LEFT JOIN outcomes USING (payee_id, imported_payee)""",
    "uncategorised",
    "outcomes",
)

# --- proposals --------------------------------------------------------------------------------


def loose(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^a-z0-9äöüß]+', ' ', 'g'))"


view(
    "raw",
    """SELECT lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS doc, 0 AS pos, CAST(NULL AS VARCHAR) AS ref, '  SHOP-' || (s_suppkey // 2) || '!' AS payee,
      CAST(NULL AS VARCHAR) AS category_ref, 'brand ' || (s_nationkey + 1) || '  large' AS category,
      round(s_acctbal / 5000, 2) AS confidence, repeat('because ', 50) AS reason FROM supplier
    UNION ALL SELECT lpad(CAST(s_suppkey AS VARCHAR), 12, '0'), 1, NULL, 'Nobody ' || s_name, NULL,
      'brand ' || (s_nationkey + 1) || '  large', 0, NULL FROM supplier
    UNION ALL SELECT lpad(CAST(s_suppkey AS VARCHAR), 12, '0'), 2, 'p' || (s_nationkey + 1), '?', 'c' || (s_nationkey * 10), 'none such', 0.5, s_name FROM supplier""",
)
view(
    "context",
    """SELECT payee, ref, tx_count, avg_amount_cents, snippets FROM shortlist
    UNION ALL SELECT payee, NULL, tx_count, avg_amount_cents, snippets FROM every_candidate WHERE payee NOT IN (SELECT payee FROM shortlist)""",
    "shortlist",
    "every_candidate",
)
view(
    "resolved_proposals",
    f"""SELECT doc, pos, confidence, reason, coalesce(r.payee, n.payee) AS payee, coalesce(cr.name, cn.name) AS category
    FROM raw LEFT JOIN context r ON r.ref = raw.ref LEFT JOIN context n ON {loose("n.payee")} = {loose("raw.payee")}
      LEFT JOIN crefs cr ON cr.ref = raw.category_ref LEFT JOIN crefs cn ON {loose("cn.name")} = {loose("raw.category")}""",
    "raw",
    "context",
    "crefs",
)
register(
    "drop_reasons",
    """SELECT CASE WHEN payee IS NULL THEN 'unknown_payee' ELSE 'unknown_category' END AS reason, count(*) AS dropped
    FROM resolved_proposals WHERE payee IS NULL OR category IS NULL GROUP BY 1""",
    "resolved_proposals",
)
view(
    "valid",
    """SELECT payee, category, CAST(round(greatest(0, least(1, p.confidence)), 3) AS DECIMAL(4,3)) AS confidence,
      left(coalesce(reason, ''), 300) AS reason, tx_count, avg_amount_cents, snippets, 'm1' AS model
    FROM (SELECT * FROM resolved_proposals WHERE payee IS NOT NULL AND category IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY payee ORDER BY doc, pos) = 1) p JOIN context USING (payee)""",
    "resolved_proposals",
    "context",
)
register(
    "validate_proposals",
    "SELECT payee, category, CAST(confidence AS VARCHAR) AS confidence, reason, tx_count, avg_amount_cents, snippets, model FROM valid",
    "valid",
)
view(
    "state1",
    """SELECT id, payee, category, confidence, reason, tx_count, avg_amount_cents, snippets, model, status, created_at
    FROM state0 WHERE status <> 'pending' OR payee NOT IN (SELECT payee FROM valid)
    UNION ALL
    SELECT coalesce(s.id, md5('run1/' || v.payee)), v.payee, v.category, v.confidence, v.reason, v.tx_count, v.avg_amount_cents,
      v.snippets, v.model, 'pending', TIMESTAMP '2024-01-20'
    FROM valid v LEFT JOIN (SELECT * FROM state0 WHERE status = 'pending') s ON s.payee = v.payee""",
    "state0",
    "valid",
)
register(
    "proposal_upsert",
    f"""SELECT id, payee, category, CAST(confidence AS VARCHAR) AS confidence, reason, tx_count, avg_amount_cents, snippets, model, status,
      {_at("created_at")} AS created FROM state1""",
    "state1",
)
register(
    "proposal_list",
    """SELECT left(id, 8) AS short_id, payee, category, CAST(confidence AS VARCHAR) AS confidence, tx_count, status
    FROM state1 WHERE status = 'pending' ORDER BY state1.confidence DESC, tx_count DESC NULLS LAST, created_at DESC, id LIMIT 200""",
    "state1",
)
view(
    "listed",
    "SELECT * FROM state1 WHERE status = 'pending'",
    "state1",
)
view(
    "approved",
    """SELECT l.id, l.payee, l.category, p.id AS payee_id, c.id AS category_id,
      'rule-' || md5(concat_ws('/', p.id, c.id)) AS rule_id,
      CASE WHEN p.id IS NULL THEN 'payee not found' WHEN c.id IS NULL THEN 'category not found' END AS error
    FROM listed l LEFT JOIN (SELECT name, min(id) AS id FROM payees GROUP BY name) p ON p.name = l.payee
      LEFT JOIN (SELECT name, min(id) AS id FROM cats WHERE NOT tombstone GROUP BY name) c ON c.name = l.category
    WHERE l.id LIKE 'a%' OR l.id LIKE '3f%' OR l.confidence >= 0.9""",
    "listed",
    "payees",
    "cats",
)
register("approve_selection", "SELECT * FROM approved", "approved")
register(
    "rule_backfill",
    "SELECT u.id, u.payee_id, a.category_id AS new_category_id, a.rule_id FROM uncategorised u JOIN approved a ON a.payee_id = u.payee_id WHERE a.error IS NULL",
    "uncategorised",
    "approved",
)
register(
    "approve_decide",
    """SELECT s.id, s.payee, CASE WHEN a.id IS NOT NULL THEN 'approved' ELSE status END AS status, a.rule_id
    FROM state1 s LEFT JOIN (SELECT * FROM approved WHERE error IS NULL) a ON a.id = s.id""",
    "state1",
    "approved",
)
register(
    "reject_selection",
    """SELECT s.id, s.payee, CASE WHEN l.id IS NOT NULL THEN 'rejected' ELSE status END AS status, CAST(NULL AS VARCHAR) AS rule_id
    FROM state1 s LEFT JOIN (SELECT id FROM listed WHERE id LIKE '0%' OR id LIKE 'c%') l ON l.id = s.id""",
    "state1",
    "listed",
)
view(
    "prompt_text",
    """SELECT string_agg(line, chr(10) ORDER BY section, position) AS prompt FROM (
      SELECT 1 AS section, -1 AS position, '## Categories ([ref] name — group)' AS line
      UNION ALL SELECT 1, position, '- [' || ref || '] ' || name || ' — ' || "group" FROM crefs
      UNION ALL SELECT 2, -2, '' UNION ALL SELECT 2, -1, '## How this household categorises (payee → category)'
      UNION ALL SELECT 2, position, '- ' || payee || ' → ' || category || '  (' || source || ')' FROM examples
      UNION ALL SELECT 3, -2, '' UNION ALL SELECT 3, -1, '## Payees without a category'
      UNION ALL SELECT 3, CAST(substr(ref, 2) AS BIGINT), '- [' || ref || '] ' || payee || ': ' || tx_count || ' transactions, avg '
        || CAST(CAST(round_even(abs(avg_amount_cents) / 100, 0) AS BIGINT) AS VARCHAR) || ' EUR '
        || CASE WHEN avg_amount_cents > 0 THEN 'income' ELSE 'expense' END || ', purpose: '
        || CASE WHEN snippets = '' THEN '(no purpose text)' ELSE '"' || replace(snippets, ' | ', '"; "') || '"' END FROM shortlist
      UNION ALL SELECT 4, 0, '' UNION ALL SELECT 4, 1, 'Return one proposal per payee listed above: its ref (p1, p2, ...) and a category_ref (c1, c2, ...).')""",
    "crefs",
    "examples",
    "shortlist",
)
register("prompt_dataset", "SELECT prompt FROM prompt_text", "prompt_text")
register(
    "prompt_enums",
    "SELECT 'category' AS kind, name AS value FROM crefs UNION SELECT 'category_ref', ref FROM crefs",
    "crefs",
)

# --- summary ----------------------------------------------------------------------------------

register("summary_accounts", "SELECT name, off_budget, balance_cents FROM balances", "balances")
register("summary_net_worth", "SELECT * FROM worth", "worth")
register("summary_ledger_rows", "SELECT source_id, count(*) AS ledger_rows FROM ledger0 GROUP BY source_id", "ledger0")
register(
    "summary_reconciliation",
    "SELECT * REPLACE (CAST(statement_balance_date AS VARCHAR) AS statement_balance_date) FROM reconciled",
    "reconciled",
)
register(
    "summary_proposals",
    """SELECT left(id, 8) AS short_id, payee, category, CAST(confidence AS VARCHAR) AS confidence, tx_count FROM state0
    WHERE status = 'pending' ORDER BY state0.confidence DESC, tx_count DESC NULLS LAST, created_at DESC, id LIMIT 15""",
    "state0",
)
register(
    "summary_runs",
    """SELECT id, source_id, strftime(started_at, '%Y-%m-%dT%H:%M') AS started_at, strftime(finished_at, '%Y-%m-%dT%H:%M') AS finished_at,
      status, fetched, new_rows, CAST(0 AS BIGINT) AS updated_rows, CAST(0 AS BIGINT) AS unchanged_rows, CAST(0 AS BIGINT) AS pending_rows,
      CAST(window_from AS VARCHAR) AS window_from, CAST(window_to AS VARCHAR) AS window_to, error, trigger_source,
      statement_balance_cents, actual_balance_cents
    FROM runs ORDER BY runs.started_at DESC, id DESC LIMIT 10""",
    "runs",
)

# --- statement files --------------------------------------------------------------------------

view(
    "file_rows",
    """SELECT s.id AS source_id, s.account_ref, s.format, s.r_name, c_nationkey AS nation, year(o_orderdate) AS y, year(o_orderdate) || '.csv' AS doc,
      o_orderkey * 2 AS row_no, CAST(o_orderdate AS DATE) AS booking_date, o_orderstatus AS status, o_orderpriority AS kind,
      CAST(round(o_totalprice * 100) AS BIGINT) AS value, o_orderkey, c_name, c_custkey,
      s.format = 'generic-csv' AND year(o_orderdate) % 2 = 1 AS unreadable
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN every_source s ON s.id = 'src' || c_nationkey""",
    "every_source",
)
view(
    "file_docs",
    """SELECT source_id, doc, format, r_name, nation, y, unreadable, nation * 100000 + y AS stated, count(*) AS n,
      count(*) FILTER (status = 'P') AS pending, max(booking_date) FILTER (status <> 'P') AS last_booking
    FROM file_rows GROUP BY ALL""",
    "file_rows",
)
register(
    "profile_resolve",
    """SELECT id AS source_id, format, CASE WHEN format = 'postbank-csv' THEN 'Buchungstag' ELSE 'booking_date' END AS marker,
      CASE WHEN r_name = 'ASIA' THEN 'Buchungstext' WHEN format = 'postbank-csv' THEN 'Verwendungszweck' ELSE 'purpose' END AS purpose_header,
      CASE WHEN format = 'postbank-csv' THEN 11 ELSE 9 END AS fields, format = 'postbank-csv' AS decimal_comma, CAST(NULL AS VARCHAR) AS config_error
    FROM sources""",
    "sources",
)
register(
    "doc_encoding",
    """SELECT source_id, doc, CASE WHEN unreadable THEN NULL WHEN y % 2 = 1 THEN 'cp1252' ELSE 'utf-8-sig' END AS encoding,
      CASE WHEN unreadable THEN 'no encoding reads the file' END AS error FROM file_docs""",
    "file_docs",
)
register(
    "header_discovery",
    """SELECT source_id, doc, CASE WHEN format = 'postbank-csv' THEN 5 ELSE 1 END AS header_line,
      CASE WHEN format = 'postbank-csv' THEN 12 ELSE 9 END AS columns, CASE WHEN format = 'postbank-csv' THEN 4 ELSE 6 END AS purpose_at
    FROM file_docs WHERE NOT unreadable""",
    "file_docs",
)
view(
    "file_balances",
    """SELECT source_id, doc, stated + CASE WHEN format = 'postbank-csv' AND nation % 2 = 0 THEN 100 ELSE 0 END AS balance_cents,
      'EUR' AS balance_currency, CASE WHEN format = 'postbank-csv' AND nation % 2 = 0 THEN make_date(y, 12, 31) END AS balance_date
    FROM file_docs WHERE NOT unreadable""",
    "file_docs",
)
register("statement_balance_parse", "SELECT *, false AS balance_error FROM file_balances", "file_balances")
view(
    "file_canonical",
    """SELECT source_id, account_ref, doc, row_no, booking_date,
      CASE status WHEN 'O' THEN booking_date + 1 WHEN 'F' THEN booking_date + 2 END AS value_date,
      CASE WHEN kind IN ('1-URGENT', '4-NOT SPECIFIED') THEN value ELSE -value END AS amount_cents,
      CASE WHEN status = 'P' THEN 'USD' ELSE 'EUR' END AS currency,
      CASE WHEN status <> 'F' THEN 'Käufer ' || c_name END AS counterpart_name,
      CASE WHEN status <> 'O' THEN 'DE001111' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS counterpart_iban,
      CASE kind WHEN '1-URGENT' THEN 'Auftrag ' || o_orderkey || ' "eilig"; sofort' WHEN '2-HIGH' THEN 'Auftrag ' || o_orderkey
        WHEN '3-MEDIUM' THEN 'Auftrag ' || o_orderkey || ' 24" Monitor' WHEN '5-LOW' THEN 'Auftrag ' || o_orderkey || chr(10) || 'später' ELSE '' END AS purpose,
      CASE status WHEN 'P' THEN 'Vorgemerkt Kartenzahlung' WHEN 'F' THEN 'SEPA-Lastschrift' END AS posting_text,
      CASE WHEN status = 'O' AND format = 'generic-csv' THEN 'R-' || o_orderkey END AS bank_reference,
      CASE WHEN status = 'O' AND format <> 'generic-csv' THEN 'E2E-' || o_orderkey END AS end_to_end_id,
      status = 'P' AS pending
    FROM file_rows WHERE NOT unreadable""",
    "file_rows",
)
register("canonical_rows", "SELECT * FROM file_canonical", "file_canonical")
register(
    "doc_stats",
    """SELECT source_id, doc, CASE WHEN unreadable THEN NULL WHEN y % 2 = 1 THEN 'cp1252' ELSE 'utf-8-sig' END AS encoding,
      CASE WHEN unreadable THEN 0 ELSE n END AS rows, CASE WHEN unreadable THEN 0 ELSE pending END AS pending_rows,
      CASE WHEN unreadable THEN 0 ELSE 2 END AS skipped_rows, CASE WHEN NOT unreadable THEN last_booking END AS last_booking,
      CASE WHEN unreadable THEN 'no encoding reads the file' END AS error FROM file_docs""",
    "file_docs",
)
register(
    "newest_statement_balance",
    """SELECT source_id, doc AS statement_doc, balance_cents AS statement_balance_cents,
      coalesce(balance_date, make_date(y + 1, 1, 5)) AS statement_balance_date
    FROM file_balances JOIN file_docs USING (source_id, doc) WHERE last_booking IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY last_booking DESC, y DESC, doc) = 1""",
    "file_balances",
    "file_docs",
)
register(
    "statement_inspect",
    """SELECT source_id, doc, row_no, booking_date, amount_cents, currency, left(coalesce(counterpart_name, posting_text, ''), 12) AS payee,
      CASE WHEN counterpart_iban IS NULL THEN '' ELSE left(counterpart_iban, 4) || '…' || right(counterpart_iban, 4) END AS iban,
      length(purpose) AS purpose_length, end_to_end_id IS NOT NULL AS has_reference
    FROM file_canonical QUALIFY row_number() OVER (PARTITION BY source_id, doc ORDER BY row_no) <= 3""",
    "file_canonical",
)

# --- scalars ----------------------------------------------------------------------------------

register(
    "parse_amount",
    """SELECT l_orderkey, l_linenumber, v AS german, v AS dotted,
      CAST(l_quantity AS BIGINT) * 100 + CASE WHEN l_linestatus = 'F' THEN 12 ELSE 14 END AS tie, CAST(NULL AS BIGINT) AS empty, true AS broken
    FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem)""",
)
register(
    "parse_date",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS german, CAST(o_orderdate AS DATE) AS iso,
      CASE WHEN day(last_day(o_orderdate)) = 31 THEN last_day(o_orderdate) END AS day31, CAST(NULL AS DATE) AS text FROM orders""",
)
register(
    "signed_amount",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN v WHEN l_returnflag = 'R' OR l_linestatus = 'O' THEN -v END AS amount_cents
    FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem)""",
)
_NORMED = f"sha256({norm('replace(text, chr(223), chr(83) || chr(83))')})"
register(
    "norm_text",
    f"SELECT doc_id, {_NORMED} AS normed FROM documents UNION ALL SELECT conv_id * 1000 + turn, {_NORMED} FROM conversations",
)
register("loose_key", f"SELECT doc_id, sha256({loose('text')}) AS loose FROM documents")
register(
    "mask_text",
    r"""SELECT doc_id, sha256(regexp_replace('an ' || iban || ' von ' || text || ' und ' || iban,
      '\b([A-Z]{2}\d{2})[A-Z0-9 ]{11,30}?([A-Z0-9]{4})\b', '\1…\2', 'g')) AS masked
    FROM (SELECT *, 'DE' || lpad(CAST(doc_id AS VARCHAR), 20, '0') AS iban FROM documents)""",
)
register(
    "mask_iban",
    """SELECT source_id, doc, row_no, left(i, 4) || '…' || right(i, 4) AS masked, '****' AS short,
      CASE WHEN end_to_end_id IS NULL THEN '' WHEN length(end_to_end_id) < 8 THEN '****'
        ELSE left(end_to_end_id, 4) || '…' || right(end_to_end_id, 4) END AS reference
    FROM (SELECT *, replace(counterpart_iban, ' ', '') AS i FROM stmt)""",
    "stmt",
)
_SNIP = r"left(trim(regexp_replace(regexp_replace(text, '\d{3,}', '#', 'g'), '\s+', ' ', 'g')), 60)"
register(
    "mask_snippet",
    f"SELECT doc_id, {_SNIP} AS snippet FROM documents UNION ALL SELECT conv_id * 1000 + turn, {_SNIP} FROM conversations",
)
register(
    "confidence",
    "SELECT event_id, greatest(0.0, least(1.0, round(CAST(round(value * 100) AS BIGINT) / 1000, 3)))::DOUBLE AS confidence, 0::DOUBLE AS word FROM events",
)
register(
    "amount_direction",
    """SELECT s_suppkey, CAST(CAST(v / 100 AS DECIMAL(20,2)) AS VARCHAR) AS amount, v AS back, CASE WHEN v > 0 THEN 'income' ELSE 'expense' END AS direction,
      CAST(CAST(round_even(abs(v) / 100, 0) AS BIGINT) AS VARCHAR) AS whole
    FROM (SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) AS v FROM supplier)""",
)

# --- files, whole jobs, streams ---------------------------------------------------------------

register("inbox_scan", "SELECT source_id, doc FROM file_docs WHERE source_id IN (SELECT id FROM sources)", "file_docs", "sources")
register("unprocessed_files", "SELECT source_id, doc FROM file_docs WHERE y >= 2000 AND source_id IN (SELECT id FROM sources)", "file_docs", "sources")
register(
    "summary_inbox",
    "SELECT s.id AS source_id, count(d.doc) AS files FROM sources s LEFT JOIN file_docs d ON d.source_id = s.id GROUP BY 1",
    "sources",
    "file_docs",
)
view(
    "import_result",
    """SELECT source_id, account, status, error, files, CASE WHEN bad THEN 0 ELSE n END AS fetched,
      CASE WHEN bad THEN 0 ELSE pending END AS pending_rows, CASE WHEN bad THEN 0 ELSE n - old END AS new_rows,
      CASE WHEN bad THEN 0 ELSE rewritten END AS changed_rows, CASE WHEN bad THEN 0 ELSE old - rewritten END AS unchanged_rows,
      CASE WHEN bad THEN 0 ELSE n - old - november - december END AS added, CASE WHEN bad THEN 0 ELSE december END AS updated,
      CASE WHEN bad THEN 0 ELSE old - rewritten + november END AS unchanged,
      CASE WHEN NOT bad THEN lo END AS window_from, CASE WHEN NOT bad THEN hi END AS window_to,
      CASE WHEN NOT bad THEN b.balance_cents END AS statement_balance_cents, CASE WHEN NOT bad AND NOT closed THEN total END AS actual_balance_cents
    FROM (SELECT source_id, bool_or(unreadable) AS bad, count(DISTINCT doc) AS files, count(*) FILTER (NOT r.pending) AS n,
        count(*) FILTER (NOT r.pending AND seen) AS old, count(*) FILTER (NOT r.pending AND seen AND m = 1) AS rewritten,
        count(*) FILTER (NOT r.pending AND NOT seen AND m = 11) AS november, count(*) FILTER (NOT r.pending AND NOT seen AND m = 12) AS december,
        count(*) FILTER (r.pending) AS pending, min(booking_date) FILTER (NOT r.pending) AS lo, max(booking_date) FILTER (NOT r.pending) AS hi,
        CAST(sum(CASE WHEN kind IN ('1-URGENT', '4-NOT SPECIFIED') THEN value ELSE -value END) FILTER (NOT r.pending) AS BIGINT) AS total,
        CASE WHEN bool_or(unreadable) THEN 'error' ELSE 'ok' END AS status,
        CASE WHEN bool_or(unreadable) THEN 'no encoding reads the file' END AS error
      FROM (SELECT *, status = 'P' AS pending, year(booking_date) < 1997 AS seen, month(booking_date) AS m FROM file_rows) r GROUP BY source_id)
    JOIN (SELECT id AS source_id, actual_account AS account FROM sources) USING (source_id)
    JOIN (SELECT name AS account, closed FROM accounts) USING (account)
    LEFT JOIN (SELECT source_id, balance_cents FROM file_balances JOIN file_docs USING (source_id, doc) WHERE last_booking IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY last_booking DESC) = 1) b USING (source_id)""",
    "file_rows",
    "file_balances",
    "sources",
    "accounts",
)
register("full_import", "SELECT * FROM import_result", "import_result")
register("stream_import", "SELECT source_id, fetched AS ledger_rows FROM import_result WHERE status = 'ok'", "import_result")
register("stream_distinct_events", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
QUERIES["categorization_round"] = QUERIES["approve_decide"]
