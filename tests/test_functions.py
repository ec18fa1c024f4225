"""Column functions on the values their definition names."""

import random
import unicodedata
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stmtflow.functions import identity, masking, parsing, text


def value(spark, build, *args):
    frame = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args))))
    return frame.select(build(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first().v


@pytest.mark.parametrize(
    "cell,comma,want",
    [
        ("1.234,56", True, 123456), ("-89,00", True, -8900), ("", True, None), (None, True, None), ("12.30", False, 1230),
        ("12.30", True, 123000), ("1e3", True, 1300), ("1e3", False, 1300), ("1,234.56 EUR", False, 123456),
        ("12,345", True, 1234), ("12,355", True, 1236), ("-0,005", True, 0), (" 1 234,5 €", True, 123450), ("EUR", True, None),
        ("+7", True, 700), ("92233720368547758,07", True, 2**63 - 1), ("-99999999999999999999,00", True, None), ("1" * 40, True, None),
    ],
)
def test_amounts(spark, cell, comma, want):
    assert value(spark, lambda c: parsing.parse_amount(c, comma), cell) == want


@pytest.mark.parametrize("cell,bad", [("abc,de", True), ("1-2", True), ("--5", True), ("", False), ("EUR", False), ("5", False), ("-99999999999999999999,00", True), ("9" * 40, True)])
def test_unreadable_amounts(spark, cell, bad):
    assert value(spark, lambda c: F.coalesce(parsing.amount_error(c, True), F.lit(False)), cell) is bad


@pytest.mark.parametrize(
    "cell,want",
    [
        ("2.1.2026", date(2026, 1, 2)), (" 02.01.2026 ", date(2026, 1, 2)), ("2026-01-02", date(2026, 1, 2)), ("2026-1-2", date(2026, 1, 2)),
        ("31.02.2026", None), ("2.1.26", None), ("", None), (None, None), ("text", None), ("012.1.2026", None),
    ],
)
def test_dates(spark, cell, want):
    formats = ["%d.%m.%Y", "%Y-%m-%d"]
    assert value(spark, lambda c: parsing.parse_date(c, formats), cell) == want
    as_column = F.array(*[F.lit(f) for f in formats])
    assert value(spark, lambda c: parsing.parse_date(c, as_column), cell) == want


@pytest.mark.parametrize(
    "formats,cell,want",
    [
        (["%d/%m/%Y"], "3/2/2026", date(2026, 2, 3)), (["%m/%d/%Y", "%d/%m/%Y"], "3/2/2026", date(2026, 3, 2)),
        (["%m/%d/%Y", "%d/%m/%Y"], "30/2/2026", None), (["%m/%d/%Y", "%d/%m/%Y"], "30/3/2026", date(2026, 3, 30)),
        (["%Y.%m.%d", "%d-%m-%Y", "%d %m %Y"], "7 12 2026", date(2026, 12, 7)), (["%d.%m.%Y"], "2026-01-02", None), ([], "2.1.2026", None),
    ],
)
def test_any_list_of_date_formats(spark, formats, cell, want):
    as_column = F.array(*[F.lit(f) for f in formats]).cast("array<string>")
    assert value(spark, lambda c: parsing.parse_date(c, as_column), cell) == want


def test_norm_and_loose_keys(spark):
    assert value(spark, text.norm, "  Muster   Energie\tGmbH ") == "MUSTER ENERGIE GMBH"
    assert value(spark, text.norm, None) == ""
    assert value(spark, text.norm, "ﬁne Straße ＡＢＣ") == "FINE STRASSE ABC"
    assert value(spark, text.loose_key, "  CAFÉ-Müller & Söhne!! ") == "caf müller söhne"
    assert value(spark, text.loose_key, "Straße") == "strasse"
    assert value(spark, text.loose_key, "?!") == ""


def test_norm_and_folding_on_every_character(spark):
    """All code points, each alone and between letters, against the rule in plain Python."""
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    words = ["".join(chars[i : i + 16]) for i in range(0, len(chars), 16)] + [f"a{c} {c}B" for c in chars[:0x3000]]
    frame = spark.createDataFrame(list(enumerate(words)), "i int, t string").repartition(4)
    got = frame.select("i", text.norm("t").alias("n"), text.casefold("t").alias("f")).collect()
    for r in got:
        assert r.n == " ".join(unicodedata.normalize("NFKC", words[r.i]).split()).upper()
        assert r.f == words[r.i].casefold()


def test_filters_pass_norm(spark, tmp_path):
    spark.createDataFrame([(i, f"Wört {i}") for i in range(9)], "i int, t string").write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t")).select("i", text.norm("t").alias("n"), text.loose_key("t").alias("k")).where("i = 4")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(i,4)" in plan and [tuple(r) for r in frame.collect()] == [(4, "WÖRT 4", "wört 4")]


def test_masks(spark):
    assert value(spark, masking.mask_iban, "DE00 1111 1111 1111 1111 11") == "DE00…1111"
    assert value(spark, masking.mask_iban, "") == ""
    assert value(spark, masking.mask_iban, None) == ""
    assert value(spark, masking.mask_iban, "short") == "****"
    assert value(spark, masking.mask_text, "paid to DE00 1111 1111 1111 1111 11 today") == "paid to DE00…1111 1111 11 today"
    assert value(spark, masking.mask_text, "an DE00111111111111111111 und zurück") == "an DE00…1111 und zurück"
    assert value(spark, masking.mask_text, "no iban here") == "no iban here"
    assert value(spark, masking.mask_snippet, "Kauf 04.01.2026 12:03 Kd-Nr 1234567 DE00111122223333") == "Kauf 04.01.# 12:03 Kd-Nr # DE#"
    assert len(value(spark, masking.mask_snippet, "x" * 200)) == 60
    assert value(spark, masking.mask_snippet, None) == ""


def test_payee_name(spark):
    assert value(spark, identity.payee_name, " Shop ", "Card") == "Shop"
    assert value(spark, identity.payee_name, "", "Card") == "Card"
    assert value(spark, identity.payee_name, None, "") == "Unknown payee"


def test_signs_and_pending(spark):
    def signed(c, d, a):
        return value(spark, lambda *x: parsing.signed_amount(*[v.cast("bigint") for v in x]), c, d, a)

    assert signed("-5", None, "9") == 5
    assert signed("0", "7", "9") == -7
    assert signed(None, "0", "-9") == -9
    assert signed(None, None, None) is None
    assert value(spark, parsing.is_pending, "Vorgemerkt Karte") is True
    assert value(spark, parsing.is_pending, "pending payment") is True
    assert value(spark, parsing.is_pending, None) is False


def read_by_python(cell, formats):
    for fmt in formats:
        try:
            return datetime.strptime(cell.strip(), fmt).date()
        except ValueError:
            continue
    return None


def test_dates_as_python_reads_them(spark):
    """Formats of every directive, cells that fit them, and cells with a character changed."""
    rng = random.Random(9)
    pieces = ["%d", "%m", "%Y", "%y", "%b", "%B", "%j", "%a", "%A", "%H", "%M", "%S", "%I", "%p", "%f", "%w", "%u", "%%"]
    marks = [".", "-", "/", " ", ", ", "", " of ", "(", "\\E", "|"]
    fixed = ["%d.%m.%y", "%d %B %Y", "%b %d, %Y", "%Y%m%d", "%y%j", "%x", "%c", "%d.%m.%Y %H:%M", "%d. %b %y", "%d%m%y", "%Y-%m-%d", "%d.%m."]
    rows = []
    for _ in range(1500):
        fmt = rng.choice(fixed) if rng.random() < 0.4 else rng.choice(marks).join(rng.sample(pieces, rng.randrange(1, 5)))
        cell = datetime(rng.randrange(1960, 2080), rng.randrange(1, 13), rng.randrange(1, 29), rng.randrange(24), 5, 9).strftime(fmt)
        if rng.random() < 0.3:
            cell = cell.upper()
        if cell and rng.random() < 0.4:
            at = rng.randrange(len(cell))
            cell = cell[:at] + rng.choice(["", "0", "9", " ", "x"]) + cell[at + rng.randrange(2) :]
        rows.append((cell, [fmt, rng.choice(fixed)]))
    rows += [(c, f) for c in ("29.02.00", "31.4.26", "68001", "69366", "00", "1 JAN 26", "29.02.") for f in (["%d.%m.%y"], ["%y%j"], ["%d %b %y"], ["%d.%m."])]
    frame = spark.createDataFrame(rows, "cell string, formats array<string>")
    for r in frame.select("*", parsing.parse_date("cell", F.col("formats")).alias("d")).collect():
        want = read_by_python(r.cell, r.formats)
        assert r.d == want, (r.cell, r.formats)


def test_known_date_formats(spark):
    formats = {"%d.%m.%y": True, "%U %Y": False, "%d%d": False, "100%%": True, "50%": False, "%c": True, "%d %x": False, "": True}
    rows = spark.createDataFrame([(f,) for f in formats], "f string").select("f", parsing.date_format_known(F.col("f"))).collect()
    assert {f: k for f, k in rows} == formats


def test_texts_are_matched_whole_and_never_searched(spark):
    """A search for a character outside of a class costs a call per place, which was most of a key's time."""
    points = [c for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    texts = spark.createDataFrame([(f"a{chr(c)}b",) for c in points] + [("",), ("a  b",), (" a\t\x1c b ",), ("ß  é",)], "t string")
    western, plain = "[^\t-\r\x1c-\x1f -~À-ÖØ-öø-ÿ]", "  |[^ -~]"
    wrong = texts.where((text._eastern(F.col("t")) != F.col("t").rlike(western)) | (text._plain(F.col("t")) == F.col("t").rlike(plain)))
    assert wrong.isEmpty()
    simple = texts.where(~text._eastern(F.col("t")))
    assert simple.where(text._squeeze_western(F.col("t")) != text.squeeze(F.col("t"))).isEmpty()
