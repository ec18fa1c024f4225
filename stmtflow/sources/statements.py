"""Statement files, line by line, to canonical rows.

Input is a ``lines`` frame: ``source_id, doc, block, line_no, raw, modified_at`` with one row per
physical line. ``raw`` holds the undecoded bytes (as a string column), and lines are ordered by
(``block``, ``line_no``) inside a document, where a block is one file split. No step needs a whole
document in one task: facts about a document are small aggregates that are joined back to lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtflow.functions.masking import mask_iban
from stmtflow.functions.codepages import decoded, gaps_of, is_utf8, page_of
from stmtflow.functions.parsing import (
    AMOUNT_CELL,
    AMOUNT_TYPE,
    DATE_INSIDE_CELL,
    amount_error,
    amount_text,
    compact_iban,
    currency_code,
    date_reader,
    is_pending,
    parse_amount,
    parse_date,
    signed_amount,
    to_cents,
)
from stmtflow.functions.ranking import first_in_group
from stmtflow.functions.text import blank_to_null, only_blanks, strip
from stmtflow.operators.keys import spanning_documents
from stmtflow.session import cut_lineage
from stmtflow.sources.profiles import CANONICAL_FIELDS

# a quoted cell up to its closing quote; a doubled quote stands for one
QUOTED = r'"([^"]*+(?:""[^"]*+)*+)"?'
MAX_FIELD = 131_072  # longest cell a CSV reader accepts, in any document
MAX_RECORD = 64 * MAX_FIELD  # longest record that is put together from lines; a quote that is never closed is longer


def _latin1() -> Column:
    return F.decode(F.col("raw").cast("binary"), "ISO-8859-1")


def _text(page: Column) -> Column:
    # the line reader has already taken a byte order mark off the first line
    plain = F.when(page.isNull(), F.col("raw")).otherwise(decoded(_latin1(), page))
    return F.regexp_replace(plain, "\r$", "")


def cell_patterns(delimiter: Column) -> list[Column]:
    """Patterns for one delimiter: ``separator``, one ``cell`` with its separator, and ``open_end``.

    Quotes only count at the start of a cell; a doubled quote inside stands for one. They are
    computed per document, so that lines only carry a reference to the same text.
    """
    d = F.concat(F.lit("\\"), delimiter)

    def pattern(template: str) -> Column:
        return F.replace(F.lit(template), F.lit("<d>"), d)

    cell = r'(?s)("[^"]*+(?:""[^"]*+)*+(?:"[^<d>]*+)?|[^<d>]*+)<d>'
    complete = r'(?:"[^"]*+(?:""[^"]*+)*+"(?:[^"<d>][^<d>]*+)?|[^"<d>][^<d>]*+)?+<d>'
    open_end = r'(?s)^(?:' + complete + r')*+"[^"]*+(?:""[^"]*+)*+$'
    return [d.alias("separator"), pattern(cell).alias("cell"), pattern(open_end).alias("open_end")]


def split_cells(text: Column, separator: Column, cell: Column, open_end: Column, delimiter: Column) -> Column:
    """Cells of one record, trimmed."""
    # a quote that is never closed runs to the end of the file
    closed = F.when(ends_open(text, open_end), F.concat(text, F.lit('"'))).otherwise(text)
    tokens = F.regexp_extract_all(F.concat(closed, delimiter), cell, F.lit(1))

    def unquote(token: Column) -> Column:
        inside = F.regexp_extract(token, "(?s)^" + QUOTED, 1)
        rest = F.regexp_extract(token, "(?s)^" + QUOTED + "(.*)$", 2)
        return F.when(
            F.startswith(token, F.lit('"')), F.concat(F.replace(inside, F.lit('""'), F.lit('"')), rest)
        ).otherwise(token)

    cells = F.when(F.contains(text, F.lit('"')), F.transform(tokens, unquote)).otherwise(F.split(text, separator))
    # most records hold no white space but blanks, which are trimmed at a fraction of the time
    return F.when(only_blanks(text), F.transform(cells, lambda c: F.trim(c))).otherwise(F.transform(cells, strip))


def ends_open(text: Column, open_end: Column) -> Column:
    """True when a line that starts outside of quotes ends inside a quoted cell."""
    return F.contains(text, F.lit('"')) & F.regexp_substr(text, open_end).isNotNull()


# --- records: join the lines of a quoted cell -----------------------------------------------


def _quote_state(df: DataFrame, keys: list[str], order: list[str], out0: str, out1: str) -> DataFrame:
    """Adds ``in0``/``in1``: the quote state before each row if the group starts outside/inside.

    A line maps the state before it to the state after it. Such a map either sets the state,
    keeps it or flips it, so the state before a row is the last one set, flipped as often as
    flips followed.
    """
    upto = Window.partitionBy(*keys).orderBy(*order)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col(out0) == F.col(out1)
    flips = (F.col(out0) == 1) & (F.col(out1) == 0)
    with_flips = df.withColumn("_flips", F.sum(flips.cast("bigint")).over(upto))
    with_last = with_flips.withColumn(
        "_set", F.last(F.when(sets, F.struct(F.col(out0).alias("s"), "_flips")), True).over(before)
    ).withColumn("_seen", F.coalesce(F.lag("_flips").over(upto), F.lit(0)))

    def state(start: int) -> Column:
        base = F.when(F.col("_set").isNull(), F.lit(start)).otherwise(F.col("_set.s"))
        flipped = F.col("_seen") - F.coalesce(F.col("_set._flips"), F.lit(0))
        return ((base + flipped) % 2).cast("int")

    return with_last.withColumn("in0", state(0)).withColumn("in1", state(1)).drop(
        "_flips", "_set", "_seen"
    )


def assemble_records(lines: DataFrame) -> DataFrame:
    """Joins the physical lines of each record for documents that quote line breaks.

    Two levels: states inside each block under both assumptions, then across the blocks of a
    document, so a large file is never sorted in one task. The text of a line travels once, and that of a record of several
    lines once more.
    """
    doc = ["source_id", "doc"]
    text, open_end = F.col("text"), F.col("open_end")
    quote = F.contains(text, F.lit('"'))
    flagged = lines.withColumn("_o0", ends_open(text, open_end).cast("int")).withColumn(
        "_o1", F.when(quote, ends_open(F.concat(F.lit('"'), text), open_end).cast("int")).otherwise(1)
    )
    states = _quote_state(flagged.drop("open_end"), [*doc, "block"], ["line_no"], "_o0", "_o1")

    def after(state: str) -> Column:
        return F.when(F.col(state) == 0, F.col("_o0")).otherwise(F.col("_o1"))

    # a record starts at every line that begins outside of quotes, maybe in an earlier block
    order = Window.partitionBy(*doc, "block").orderBy("line_no")
    inside = order.rowsBetween(Window.unboundedPreceding, 0)

    def here(state: str) -> Column:
        return F.last(F.when(F.col(state) == 0, F.col("line_no")), True).over(inside)

    def same_place(neighbour: Column) -> Column:
        return F.coalesce(neighbour.over(order) == F.col("line_no"), F.lit(False))

    local = cut_lineage(
        states.withColumns({
            "_h0": here("in0"), "_h1": here("in1"), "_shared": same_place(F.lag("line_no")) | same_place(F.lead("line_no")),
        }).select(
            *doc, "block", "line_no", "text", "_h0", "_h1", after("in0").alias("_a0"), after("in1").alias("_a1"),
            # one line that is a record by itself
            *[((F.col(i) == 0) & (after(i) == 0) & ~F.col("_shared") & (F.octet_length("text") < MAX_RECORD)).alias(w) for i, w in (("in0", "_w0"), ("in1", "_w1"))],
        )
    )
    ends = local.groupBy(*doc, "block").agg(
        F.max_by("_a0", "line_no").alias("_b0"), F.max_by("_a1", "line_no").alias("_b1"),
        F.max("_h0").alias("_l0"), F.max("_h1").alias("_l1"),
    )
    earlier = Window.partitionBy(*doc).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outside = F.col("in0") == 0
    last = F.when(outside, F.col("_l0")).otherwise(F.col("_l1")).alias("line_no")
    starts = cut_lineage(
        _quote_state(ends, doc, ["block"], "_b0", "_b1")
        .select(*doc, "block", outside.alias("_outside"), F.when(last.isNotNull(), F.struct("block", last)).alias("_last"))
        .select(*doc, "block", "_outside", F.last("_last", True).over(earlier).alias("_carried"))
    )

    def chosen(name: str) -> Column:
        return F.when(F.col("_outside"), F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    placed = local.join(starts, [*doc, "block"]).withColumns({"_whole": chosen("_w"), "_here": chosen("_h")})
    parts = placed.where(~F.col("_whole")).withColumn(
        "_at", F.when(F.col("_here").isNull(), F.col("_carried")).otherwise(F.struct("block", F.col("_here").alias("line_no")))
    )
    # a record longer than any may be is an error of the document, not something to collect
    too_long = cut_lineage(
        parts.groupBy(*doc, "_at").agg(F.sum(F.length("text") + 1).alias("_chars")).where(F.col("_chars") > MAX_RECORD)
        .select(*doc, "_at", F.lit(True).alias("_too_long"))
    )
    piece = F.struct("block", "line_no", F.col("text").alias("t"))
    joined = (
        parts.join(too_long, [*doc, "_at"], "left")
        .groupBy(*doc, "_at")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("_too_long").isNull(), piece))).alias("_pieces"),
            F.max("_too_long").isNotNull().alias("too_long"),
        )
        .select(*doc, "_at.*", F.array_join(F.transform("_pieces", lambda p: p["t"]), "\n").alias("text"), "too_long")
    )
    whole = placed.where("_whole").select(*doc, "block", "line_no", "text", F.lit(False).alias("too_long"))
    return whole.unionByName(joined)


# --- documents --------------------------------------------------------------------------------


def decode_documents(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """Encoding per document: the first of the profile's encodings that reads every byte.

    ``broken`` marks documents in which some line ends inside a quoted cell. Quotes, delimiters
    and line ends are the same bytes in every encoding, so this shows before decoding.
    """
    candidates = F.transform(
        "encodings", lambda e: F.struct(e.alias("name"), is_utf8(e).alias("utf8"), page_of(e).alias("page"), gaps_of(page_of(e)).alias("gaps"))
    )
    # one row per source: written, so that the planner knows its size and no line travels to meet its format
    formats = cut_lineage(formats.select("*", *cell_patterns(F.col("delimiter")), candidates.alias("candidates")))
    tested = lines.join(formats.select("source_id", "open_end", "candidates"), "source_id").withColumn("_latin1", _latin1())

    def reads(e: Column) -> Column:
        return F.when(e["utf8"], F.is_valid_utf8("raw")).otherwise(~F.exists(e["gaps"], lambda g: F.contains("_latin1", g)))

    # every encoding reads ASCII; of other lines one bit per encoding, so the bits of a document are those of all its lines
    bits = F.aggregate(
        F.transform("candidates", lambda e, i: F.when(reads(e), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0))),
        F.lit(0).cast("bigint"), lambda a, b: a + b,
    )
    # each byte beyond ASCII takes two in the text of a one-byte page
    ascii_only = F.octet_length("_latin1") == F.octet_length("raw")
    open_line = F.contains("raw", F.lit('"')) & ends_open(F.col("_latin1"), F.col("open_end"))
    per_doc = tested.groupBy("source_id", "doc").agg(
        F.bit_and(F.when(~ascii_only, bits).otherwise(F.lit(-1).cast("bigint"))).alias("_reads"),
        F.max("modified_at").alias("modified_at"),
        F.bool_or(open_line).alias("broken"),
    )
    fit = F.filter("candidates", lambda e, i: F.call_function("getbit", F.col("_reads"), i) == 1)
    return (
        per_doc.join(formats.where("config_error is null"), "source_id")
        .withColumn("_chosen", F.get(fit, F.lit(0)))
        .withColumns({"encoding": F.col("_chosen.name"), "page": F.col("_chosen.page")})
        .drop("_reads", "_chosen", "candidates", "encodings", "config_error")
    )


def decoded_records(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """Logical records with their cells, for documents that could be decoded."""
    doc = ["source_id", "doc"]
    readable = documents.where("encoding is not null")
    text = (
        lines.select(*doc, "block", "line_no", "raw").join(readable.select(*doc, "page", "broken", "open_end"), doc)
        .withColumn("text", _text(F.col("page"))).drop("raw", "page")
    )
    records = text.where(~F.col("broken")).drop("broken", "open_end").withColumn("too_long", F.lit(False))
    # documents are a small written table: only build the assembly if some need it
    if not readable.where("broken").isEmpty():
        records = records.unionByName(assemble_records(text.where("broken").drop("broken")))
    # the patterns of a document meet its records here, so that they do not travel with them
    records = records.join(readable.select(*doc, "delimiter", "marker", "balance_label", "separator", "cell", "open_end"), doc)
    first_cell = F.lower(F.get("cells", F.lit(0)))
    return (
        records.withColumn("cells", split_cells(*map(F.col, ("text", "separator", "cell", "open_end", "delimiter"))))
        .withColumn("too_long", F.col("too_long") | ((F.octet_length("text") > MAX_FIELD) & F.exists("cells", lambda c: F.char_length(c) > MAX_FIELD)))
        .withColumn("at", F.struct("block", "line_no"))
        .withColumn("is_header", F.array_contains("cells", F.col("marker")))
        .withColumn("is_balance", F.contains(first_cell, F.lower("balance_label")))
        .select("source_id", "doc", "at", "cells", "is_header", "is_balance", "too_long")
    )


def with_headers(documents: DataFrame, records: DataFrame) -> DataFrame:
    """Adds the header line, its cells, the position of each canonical field and ``error``."""
    headers = (
        records.where("is_header")
        .groupBy("source_id", "doc")
        .agg(F.min("at").alias("header_at"), F.min_by("cells", "at").alias("header"))
    )

    def position(name: str) -> Column:
        # a header text that occurs twice means its last column
        back = F.array_position(F.reverse("header"), F.element_at("columns", F.lit(name)))
        return F.when(back > 0, F.size("header") - back).cast("int")

    return (
        documents.join(headers, ["source_id", "doc"], "left")
        .withColumn("positions", F.struct(*[position(f).alias(f) for f in CANONICAL_FIELDS]))
        .withColumn(
            "error",
            F.when(F.col("encoding").isNull(), F.lit("no encoding reads the file")).when(
                F.col("header_at").isNull(),
                F.concat(F.lit("no header row with column "), F.col("marker")),
            ),
        )
    )


def statement_balances(documents: DataFrame, records: DataFrame) -> DataFrame:
    """Balance, currency and date stated above the header, one row per document that has one.

    Later balance lines override earlier ones field by field.
    """
    known = documents.where("error is null").select(
        "source_id", "doc", "header_at", "decimal_comma", "date_formats", F.transform("date_formats", date_reader).alias("date_readers"),
        "default_currency",
    )
    preamble = (
        records.where("is_balance")
        .join(known, ["source_id", "doc"])
        .where(F.col("at") < F.col("header_at"))
    )
    amount = F.get(
        F.filter(F.slice("cells", 2, F.size("cells")), lambda c: c.rlike(AMOUNT_CELL)), F.lit(0)
    )
    codes = F.filter("cells", lambda c: c.rlike(r"(?U)^\p{Lu}{3}$"))
    code = F.get(codes, F.size(codes) - 1)
    dates = F.filter(
        F.transform(
            "cells",
            lambda c: F.coalesce(
                parse_date(c, F.col("date_formats"), F.col("date_readers")),
                parse_date(F.regexp_extract(c, DATE_INSIDE_CELL, 0), F.col("date_formats"), F.col("date_readers")),
            ),
        ),
        lambda d: d.isNotNull(),
    )
    lines = preamble.select(
        "source_id",
        "doc",
        "at",
        parse_amount(amount, F.col("decimal_comma")).alias("cents"),
        F.coalesce(amount_error(amount, F.col("decimal_comma")), F.lit(False)).alias("bad"),
        F.coalesce(
            code,
            F.when(
                amount.isNotNull(),
                F.coalesce(
                    F.nullif(F.regexp_extract(amount, "[A-Z]{3}$", 0), F.lit("")),
                    F.col("default_currency"),
                ),
            ),
        ).alias("currency"),
        F.get(dates, F.size(dates) - 1).alias("date"),
    )

    def latest(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("at")))

    return lines.groupBy("source_id", "doc").agg(
        latest("cents").alias("balance_cents"),
        latest("currency").alias("balance_currency"),
        latest("date").alias("balance_date"),
        F.bool_or("bad").alias("balance_error"),
    )


def canonical_rows(documents: DataFrame, records: DataFrame) -> DataFrame:
    """Every record below the header as a canonical row.

    ``is_row`` is false for lines that are not bookings, ``bad_amount`` marks unreadable amounts.
    """
    known = documents.where("error is null").select(
        "source_id",
        "account_ref",
        "doc",
        "header_at",
        "positions",
        "decimal_comma",
        "date_formats",
        F.transform("date_formats", date_reader).alias("date_readers"),
        "default_currency",
    )
    body = records.join(known, ["source_id", "doc"]).where(F.col("at") > F.col("header_at"))

    # step by step, so that no expression is repeated inside another one
    comma = F.col("decimal_comma")
    named = body.select(
        "source_id", "account_ref", "doc", "at", "too_long", "decimal_comma", "date_formats", "date_readers", "default_currency",
        *[F.get("cells", F.col(f"positions.{name}")).alias(f"c_{name}") for name in CANONICAL_FIELDS],
    )
    amounts = ("credit", "debit", "amount")
    numbers = named.withColumns({f"t_{n}": amount_text(f"c_{n}", comma) for n in amounts})
    numbers = numbers.withColumns({f"d_{n}": F.col(f"t_{n}").try_cast(AMOUNT_TYPE) for n in amounts})
    values = numbers.withColumns(
        {
            **{n: to_cents(F.col(f"d_{n}")) for n in amounts},
            **{f"bad_{n}": F.col(f"t_{n}").isNotNull() & to_cents(F.col(f"d_{n}")).isNull() for n in amounts},
            "booking_date": parse_date("c_booking_date", F.col("date_formats"), F.col("date_readers")),
        }
    )
    # the amount column is only read where credit and debit say nothing
    moved = (F.coalesce("credit", F.lit(0)) != 0) | (F.coalesce("debit", F.lit(0)) != 0)
    rows = values.select(
        "source_id",
        "account_ref",
        "doc",
        F.col("at.block").alias("block"),
        F.col("at.line_no").alias("row_no"),
        "booking_date",
        parse_date("c_value_date", F.col("date_formats"), F.col("date_readers")).alias("value_date"),
        signed_amount("credit", "debit", "amount").alias("amount_cents"),
        currency_code("c_currency", F.col("default_currency")).alias("currency"),
        blank_to_null("c_counterpart_name").alias("counterpart_name"),
        compact_iban("c_counterpart_iban").alias("counterpart_iban"),
        F.coalesce(strip("c_purpose"), F.lit("")).alias("purpose"),
        blank_to_null("c_posting_text").alias("posting_text"),
        blank_to_null("c_bank_reference").alias("bank_reference"),
        blank_to_null("c_end_to_end_id").alias("end_to_end_id"),
        (F.col("bad_credit") | F.col("bad_debit") | (~moved & F.col("bad_amount"))).alias("_bad"),
        "too_long",
    )
    dated = F.col("booking_date").isNotNull()
    return (
        rows.withColumn("bad_amount", dated & F.col("_bad"))
        .withColumn("is_row", dated & F.col("amount_cents").isNotNull() & ~F.col("_bad"))
        .withColumn("pending", is_pending("posting_text"))
        .drop("_bad")
    )


def document_stats(documents: DataFrame, rows: DataFrame, balances: DataFrame) -> DataFrame:
    """Counts, header, encoding, stated balance and error of each document."""
    counts = rows.groupBy("source_id", "doc").agg(
        F.count_if("is_row").alias("rows"),
        F.count_if(F.col("is_row") & F.col("pending")).alias("pending_rows"),
        F.count_if(~F.col("is_row")).alias("skipped_rows"),
        F.max(F.when(F.col("is_row") & ~F.col("pending"), F.col("booking_date"))).alias("last_booking"),
        F.bool_or("bad_amount").alias("_bad"),
        F.bool_or("too_long").alias("_long"),
    )
    return (
        documents.select("source_id", "doc", "encoding", "header", "modified_at", "error")
        .join(counts, ["source_id", "doc"], "left")
        .join(balances, ["source_id", "doc"], "left")
        .withColumn(
            "error",
            F.coalesce(
                F.col("error"),
                F.when(F.col("_bad") | F.coalesce("balance_error", F.lit(False)), F.lit("cannot parse amount")),
                F.when(F.col("_long"), F.lit("cell too long")),
            ),
        )
        .drop("_bad", "_long", "balance_error")
        .fillna(0, ["rows", "pending_rows", "skipped_rows"])
    )


class ParsedStatements:
    """What the lines of many statement files say.

    Records and document facts are written once to the shared folder, since header, balances and
    rows all read them; the lines themselves are read twice, for the facts and for the records.
    """

    def __init__(self, lines: DataFrame, formats: DataFrame):
        decoded = cut_lineage(decode_documents(lines, formats))
        records = cut_lineage(decoded_records(lines, decoded))
        self.documents = cut_lineage(with_headers(decoded, records))
        self.records = records
        self.balances = statement_balances(self.documents, records)
        self.body = canonical_rows(self.documents, records)
        self.rows = self.body.where("is_row").drop("is_row", "bad_amount", "too_long")
        self.stats = document_stats(self.documents, self.body, self.balances)

    def long_documents(self) -> DataFrame:
        return spanning_documents(self.records, "at.block")


def inspect_rows(rows: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` rows of each document with identifiers hidden."""
    return first_in_group(
        rows.withColumn("_at", F.struct("block", "row_no")), ["source_id", "doc"], ["_at"], n
    ).select(
        "source_id",
        "doc",
        "row_no",
        "booking_date",
        "amount_cents",
        "currency",
        F.left(F.coalesce("counterpart_name", "posting_text", F.lit("")), F.lit(12)).alias("payee"),
        mask_iban("counterpart_iban").alias("iban"),
        F.char_length("purpose").cast("bigint").alias("purpose_length"),
        F.col("end_to_end_id").isNotNull().alias("has_reference"),
    )
