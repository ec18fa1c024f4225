"""Statement files: encodings, headers, quoting, balances, errors."""

import codecs
import csv
import io
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from stmtflow.functions import codepages
from stmtflow.functions.parsing import parse_amount, parse_date
from stmtflow.sources import inbox, statements
from stmtflow.sources.profiles import BUILT_IN_PROFILES, profiles_frame, resolve_profiles
from stmtflow.sources.statements import ParsedStatements, inspect_rows
from stmtflow.schemas import SOURCE
from tests import files

SOURCES = [
    ("pb", "manual_import", "Giro", "giro", "EUR", "postbank-csv", "pb/*.csv", None),
    ("gen", "manual_import", "Loan", "loan", "EUR", "generic-csv", "gen/**/*.csv", {"purpose": "note"}),
]


def parse(spark, folder, sources=SOURCES, profiles=None):
    formats = resolve_profiles(spark.createDataFrame(sources, SOURCE), profiles or profiles_frame(spark))
    root = str(folder)
    found = inbox.source_files(inbox.inbox_files(spark, root), formats)
    return ParsedStatements(inbox.lines_of(inbox.read_lines(spark, root), found), formats)


def test_bank_file(spark, tmp_path):
    files.write(tmp_path, "pb/a.csv", files.bank_text())
    files.write(tmp_path, "pb/processed/old.csv", files.bank_text())
    files.write(tmp_path, "other/x.csv", files.bank_text())
    parsed = parse(spark, tmp_path)
    stats = parsed.stats.collect()
    assert len(stats) == 1
    doc = stats[0]
    assert (doc.doc, doc.encoding, len(doc.header), doc.rows, doc.pending_rows, doc.skipped_rows) == ("pb/a.csv", "utf-8-sig", 18, 5, 1, 1)
    assert (doc.balance_cents, doc.balance_currency, doc.balance_date, doc.error) == (120456, "EUR", None, None)
    rows = parsed.rows.orderBy("block", "row_no").collect()
    assert (rows[0].booking_date, rows[0].amount_cents, rows[0].counterpart_name) == (date(2026, 2, 3), -7500, "Stadtwerke Probe")
    assert rows[0].counterpart_iban == "DE00333333333333333333"
    assert (rows[3].amount_cents, rows[3].end_to_end_id) == (250000, "E2E-7")
    assert [r.pending for r in rows] == [False] * 4 + [True]
    shown = inspect_rows(parsed.rows).orderBy("row_no").collect()
    assert len(shown) == 3 and (shown[0].payee, shown[0].iban) == ("Stadtwerke P", "DE00…3333")


def test_fallback_encoding_and_generic_format(spark, tmp_path):
    files.write(tmp_path, "pb/latin.csv", files.bank_text(), "cp1252")
    files.write(tmp_path, "gen/2026/g.csv", (
        "Balance as of 2026-01-31;1,000.50 CHF\nbooking_date;value_date;amount;currency;counterpart;counterpart_iban;note;type;reference\n"
        "2026-01-02;;-12.30;;Lender;;Rate;;R1\n2026-01-03;;;;Lender;;no amount;;\n2026-01-04;03.01.2026;1,200.5;chf\n"
    ))
    parsed = parse(spark, tmp_path)
    stats = {r.doc: r for r in parsed.stats.collect()}
    assert stats["pb/latin.csv"].encoding == "cp1252" and stats["pb/latin.csv"].rows == 5
    names = [r.counterpart_name for r in parsed.rows.where("doc = 'pb/latin.csv'").orderBy("row_no").collect()]
    assert names[1] == "Bäckerei Probe"
    g = stats["gen/2026/g.csv"]
    assert (g.rows, g.skipped_rows, g.balance_cents, g.balance_currency, g.balance_date) == (2, 1, 100050, "CHF", date(2026, 1, 31))
    rows = parsed.rows.where("source_id = 'gen'").orderBy("row_no").collect()
    assert [(r.amount_cents, r.currency, r.purpose, r.bank_reference, r.value_date) for r in rows] == [
        (-1230, "EUR", "Rate", "R1", None), (120050, "CHF", "", None, date(2026, 1, 3)),
    ]


def test_code_pages_read_as_python_does(spark):
    every = codepages.pages()
    assert {"cp1250", "cp437", "koi8_r", "iso8859_2", "latin_1", "cp1252", "mac_roman"} <= set(every) and "cp037" not in every
    every = sorted(set(every) - {"ansi_x3_4_1986", "iso_646_irv_1991", "cshproman8"})  # the codecs spell these with dots or capitals
    assert all(codecs.lookup(n) for n in every)
    frame = spark.createDataFrame([(n, bytearray(range(1, 256))) for n in every], "name string, raw binary")
    out = frame.select("name", codepages.decoded(F.decode("raw", "ISO-8859-1"), codepages.page_of(F.col("name")))).collect()
    for name, text in out:
        want = "".join(bytes([b]).decode(name, "ignore") or codepages.NONE for b in range(1, 256))
        assert text == want, name


@pytest.mark.parametrize("encoding,name,chosen", [
    ("cp1250", "Łódź", "cp1250"), ("cp437", "Müller ½", "IBM437"), ("iso-8859-2", "Žižkov", "ISO 8859-2"), ("utf-8", "Łódź", "utf-8-sig"), ("koi8-r", "Москва", "koi8-r"),
])
def test_files_in_other_encodings(spark, tmp_path, encoding, name, chosen):
    """The first encoding of the list that defines every byte; one that leaves a byte out is passed over."""
    row = files.bank_row("3.2.2026", "Karte", name, "x", debit="-1,00")
    header = files.HEADER.replace("ü", "ue").replace("ä", "ae").replace("Gebühren", "Geb")
    text = files.bank_text([row], ["Umsatz;"], header, [])
    files.write(tmp_path, "in/a.csv", text, encoding)
    columns = {c: h.replace("ü", "ue").replace("ä", "ae") for c, h in BUILT_IN_PROFILES[0]["columns"].items()}
    profile = {**BUILT_IN_PROFILES[0], "id": "p", "columns": columns, "encodings": ["utf-8-sig", "ascii", chosen]}
    source = spark.createDataFrame([("s", "manual_import", "A", "a", "EUR", "p", "in/*", None)], SOURCE)
    formats = resolve_profiles(source, profiles_frame(spark, [profile]))
    raw = (tmp_path / "in" / "a.csv").read_bytes().split(b"\n")[:-1]
    lines = spark.createDataFrame([("s", "d", 0, i, bytearray(r)) for i, r in enumerate(raw)], "source_id string, doc string, block bigint, line_no bigint, raw binary")
    parsed = ParsedStatements(lines.withColumns({"raw": F.col("raw").cast("string"), "modified_at": F.current_timestamp()}), formats)
    assert [(r.counterpart_name, r.purpose) for r in parsed.rows.collect()] == [(name, "x")]
    assert parsed.stats.first().encoding == chosen and formats.first().config_error is None


def test_errors_stay_with_their_document(spark, tmp_path):
    bad = files.bank_row("7.2.2026", "Karte", "X", "Y", debit="zwölf,3-4")
    dateless = files.bank_row("kein Datum", "Karte", "X", "Y", debit="1-2")
    files.write(tmp_path, "pb/bad.csv", files.bank_text([*files.ROWS, bad]))
    files.write(tmp_path, "pb/nohead.csv", "a;b\nc;d\n")
    files.write(tmp_path, "pb/fine.csv", files.bank_text([*files.ROWS, dateless]))
    (tmp_path / "pb" / "bytes.csv").write_bytes(files.bank_text().encode("cp1252") + b"\x81\n")
    errors = {r.doc: r.error for r in parse(spark, tmp_path).stats.collect()}
    assert errors == {
        "pb/bad.csv": "cannot parse amount", "pb/nohead.csv": "no header row with column Buchungstag",
        "pb/fine.csv": None, "pb/bytes.csv": "no encoding reads the file",
    }


def test_profiles(spark):
    rows = [
        ("a", "manual_import", "A", "a", "EUR", "postbank-csv", "a/*", {"purpose": "Text"}),
        ("b", "manual_import", "A", "a", "EUR", "postbank-csv", "a/*", {"colour": "X"}),
        ("c", "manual_import", "A", "a", "EUR", "nope", "a/*", None),
        ("d", "manual_import", "A", "a", "EUR", "postbank-csv", None, None),
    ]
    got = {r.source_id: r for r in resolve_profiles(spark.createDataFrame(rows, SOURCE), profiles_frame(spark)).collect()}
    assert got["a"].columns["purpose"] == "Text" and got["a"].columns["amount"] == "Betrag" and got["a"].config_error is None
    assert got["b"].config_error == "unknown canonical fields: colour"
    assert got["c"].config_error == "unknown format profile nope"
    assert got["d"].config_error == "inbox_glob is required"


def test_balance_lines_override_field_by_field(spark, tmp_path):
    preamble = [
        "Kontostand am 05.01.2026;;10,00;CHF", "alter KONTOSTAND;;20,00 USD", "Kontostand;;EURO;30.01.2026", "Kontostand;;7,00;;",
    ]
    files.write(tmp_path, "pb/a.csv", files.bank_text(preamble=preamble))
    doc = parse(spark, tmp_path).stats.first()
    assert (doc.balance_cents, doc.balance_currency, doc.balance_date) == (700, "EUR", date(2026, 1, 30))


def lines_frame(spark, text, per_block):
    physical = text.split("\n")
    if physical[-1] == "":
        physical.pop()
    rows = [("s", "d", i // per_block, i, line) for i, line in enumerate(physical)]
    frame = spark.createDataFrame(rows, "source_id string, doc string, block bigint, line_no bigint, raw string")
    return frame.withColumn("modified_at", F.current_timestamp())


@pytest.mark.parametrize("delimiter,per_block", [(";", 3), (",", 1), ("\t", 100)])
def test_quoting_equals_a_csv_reader(spark, delimiter, per_block):
    rng = random.Random(per_block)
    pieces = ["a", " b ", '"x"', '"p""q"', f'"u{delimiter}v"', '"two\nlines"', '"three\n\n""lines"', 'stray"quote', '"tail"x', "", '""', '"\n"']
    body = "\n".join(delimiter.join(rng.choice(pieces) for _ in range(rng.randrange(1, 6))) for _ in range(120))
    header = delimiter.join(["first", "when", "sum"])
    for ending in ("", "\n", f'\nx{delimiter}"never closed\nto the end'):
        content = header + "\n" + body + ending
        profile = {**BUILT_IN_PROFILES[0], "id": "p", "columns": {"booking_date": "when", "amount": "sum"}, "delimiter": delimiter, "balance_label": None}
        source = [("s", "manual_import", "A", "a", "EUR", "p", "x", None)]
        formats = resolve_profiles(spark.createDataFrame(source, SOURCE), profiles_frame(spark, [profile]))
        parsed = ParsedStatements(lines_frame(spark, content, per_block), formats)
        got = [r.cells for r in parsed.records.orderBy("at").collect()]
        want = [[c.strip() for c in row] or [""] for row in csv.reader(io.StringIO(content), delimiter=delimiter)]
        assert got == want


def test_amount_text_of_profile_column(spark):
    frame = spark.createDataFrame([("1.234,5", True), ("1,234.5", False)], "t string, comma boolean")
    assert [r.v for r in frame.select(parse_amount("t", F.col("comma")).alias("v")).collect()] == [123450, 123450]


def parsed_with(spark, text, **changes):
    profile = {**BUILT_IN_PROFILES[0], "id": "p", **changes}
    formats = resolve_profiles(spark.createDataFrame([("s", "manual_import", "A", "a", "EUR", "p", "x", None)], SOURCE), profiles_frame(spark, [profile]))
    return formats, ParsedStatements(lines_frame(spark, text, 3), formats)


def test_cells_have_one_limit_in_every_document(spark):
    header = "Buchungstag;Betrag;Verwendungszweck\n"
    fine, long = "x" * 70_000, "y" * 140_000
    quoted = f'3.2.2026;1,00;"{fine}\n{fine[:100]}"\n4.2.2026;"{fine}\n";"{fine}"\n'
    cases = {
        header + quoted: None,  # a record may be longer than a cell
        header + f"3.2.2026;1,00;{long}\n": "cell too long",
        header + f'3.2.2026;1,00;"{long}"\n5.2.2026;2,00;"a\nb"\n': "cell too long",
        header + f"3.2.2026;1,00;{fine}\n": None,
    }
    for text, error in cases.items():
        _, parsed = parsed_with(spark, text)
        assert parsed.stats.first().error == error


def test_dates_and_encodings_of_a_profile(spark):
    text = "Buchungstag;Betrag;Verwendungszweck\n13/2/2026;1,00;a\n2026/02/14;2,00;b\n"
    formats, parsed = parsed_with(spark, text, date_formats=["%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%Y/%m/%d"], encodings=["latin-1"])
    assert formats.first().config_error is None
    assert sorted(str(r.booking_date) for r in parsed.rows.collect()) == ["2026-02-13", "2026-02-14"]
    for change, error in (({"date_formats": ["%d.%m.%y", "%U %Y", "%d %d"]}, "unsupported date format: %U %Y, %d %d"), ({"encodings": ["utf-16"]}, "unsupported encoding: utf-16")):
        formats, _ = parsed_with(spark, text, **change)
        assert formats.first().config_error == error


def test_text_of_a_line_travels_once(spark, monkeypatch):
    """Lines meet their format and the state of their block in place; only records of several lines are exchanged again."""
    monkeypatch.setattr(statements, "MAX_RECORD", 100)
    plans, cut = [], statements.cut_lineage

    def recorded(df):
        plans.append(spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))
        return cut(df)

    monkeypatch.setattr(statements, "cut_lineage", recorded)
    _, parsed = parsed_with(spark, 'Buchungstag;Betrag;Verwendungszweck\n3.2.2026;1,00;"a\nb"\n4.2.2026;2,00;c\n')
    inputs = [columns for plan in plans for columns in re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)]
    assert sum(bool(re.search(r"\b(raw|text)#", columns)) for columns in inputs) == 1
    assert [(r.row_no, r.purpose) for r in parsed.rows.orderBy("row_no").collect()] == [(1, "a\nb"), (3, "c")]


@pytest.mark.parametrize("limit,error", [(60, None), (59, "cell too long")])
def test_records_over_several_blocks_have_one_limit(spark, monkeypatch, limit, error):
    monkeypatch.setattr(statements, "MAX_RECORD", limit)
    text = 'Buchungstag;Betrag;Verwendungszweck\n3.2.2026;1,00;"' + "a\n" * 21 + 'b"\n4.2.2026;2,00;c\n'
    _, parsed = parsed_with(spark, text)
    assert parsed.stats.first().error == error
    assert ("a\n" * 21 + "b" in [r.purpose for r in parsed.rows.collect()]) == (error is None)


def test_cells_keep_all_but_white_space_at_their_ends(spark):
    text = "Buchungstag;Betrag;Verwendungszweck\n 3.2.2026 ;1,01;  2 Stück 2 \n4.2.2026;2,00; x \n5.2.2026;3,00;\"  1 2\n\"\n"
    _, parsed = parsed_with(spark, text)
    got = [r.cells for r in parsed.records.orderBy("at").collect()]
    assert got[1:] == [["3.2.2026", "1,01", "2 Stück 2"], ["4.2.2026", "2,00", "x"], ["5.2.2026", "3,00", "1 2"]]


def test_usual_formats_in_the_other_order_read_the_same_dates(spark):
    cells = ["3.2.2026", "2026-02-03", "2026-02- 3", "31.2.2026", "0.1.2026", "3.2.0000", "2026-2-3", "3. 2.2026", "", "2026-02-03x"]
    want = [date(2026, 2, 3)] * 3 + [None] * 3 + [date(2026, 2, 3)] + [None] * 3
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    assert [r.d for r in frame.select("i", parse_date("c", ["%Y-%m-%d", "%d.%m.%Y"]).alias("d")).orderBy("i").collect()] == want


def test_amounts_lose_their_noise(spark):
    cells = [("EUR 1.234,50", True), ("-1 000,5 €", True), ("1,234.50 $", False), ("£ ", False), ("1..2,,3", True)]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "i int, c string, comma boolean")
    assert [r.v for r in frame.select("i", parse_amount("c", F.col("comma")).alias("v")).orderBy("i").collect()] == [123450, -100050, 123450, None, None]
