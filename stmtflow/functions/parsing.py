"""Cells of a statement file to typed values."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stmtflow.functions.text import as_column, blank_to_null, strip

# Must equal the format definition for results to be right.
PENDING_MARKERS = "VORGEMERKT|VORMERKUNG|PENDING"
AMOUNT_NOISE = "\xa0 " + string.ascii_letters + "€$£"
AMOUNT_CELL = (
    r"^[-+]?[\d.]*\d,\d{2}( ?[A-Z]{3})?$|^[-+]?\d[\d,]*\.\d{2}( ?[A-Z]{3})?$"
)
DATE_INSIDE_CELL = r"\d{1,2}\.\d{1,2}\.\d{4}|\d{4}-\d{2}-\d{2}"
AMOUNT_TYPE = "decimal(36,10)"
_SPARK_FIELD = {"%d": "d", "%m": "M", "%Y": "yyyy"}
_SHAPE = {"%d": r"\d{1,2}", "%m": r"\d{1,2}", "%Y": r"\d{4}"}
# What each directive of a date format stands for, in the C locale.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
DIRECTIVES = {
    "%d": r"3[01]|[12]\d|0?[1-9]| [1-9]",
    "%m": r"1[0-2]|0?[1-9]",
    "%Y": r"\d{4}",
    "%y": r"\d{2}",
    "%j": r"36[0-6]|3[0-5]\d|[12]\d\d|0\d[1-9]|0[1-9]0|0?[1-9]\d|0?[1-9]",
    "%b": "|".join(m[:3] for m in MONTHS),
    "%B": "|".join(sorted(MONTHS, key=len, reverse=True)),
    "%a": "|".join(d[:3] for d in DAYS),
    "%A": "|".join(sorted(DAYS, key=len, reverse=True)),
    "%w": "[0-6]",
    "%u": "[1-7]",
    "%H": r"2[0-3]|[01]\d|\d",
    "%I": r"1[0-2]|0?[1-9]",
    "%M": r"[0-5]\d|\d",
    "%S": r"6[01]|[0-5]\d|\d",
    "%f": r"\d{1,6}",
    "%p": "am|pm",
}
COMPOSED = {"%c": "%a %b %d %H:%M:%S %Y", "%x": "%m/%d/%y", "%X": "%H:%M:%S"}
#: Years of two digits up to this one lie in this century.
PIVOT = 68
DIRECTIVE = "(?s)%.?"


USUAL_FORMATS = ["%d.%m.%Y", "%Y-%m-%d"]


def amount_text(value: Column | str, decimal_comma: Column | bool) -> Column:
    """The number inside an amount cell with '.' as decimal mark; null when the cell is empty."""
    comma = decimal_comma if isinstance(decimal_comma, Column) else F.lit(decimal_comma)
    bare = strip(value)
    # what a second list has no partner for is dropped: the noise and the mark between thousands
    german = F.translate(bare, ",." + AMOUNT_NOISE, ".")
    return F.nullif(F.when(comma, german).otherwise(F.translate(bare, "," + AMOUNT_NOISE, "")), F.lit(""))


def to_cents(number: Column) -> Column:
    """Decimal to minor units, ties to the even cent; null beyond what minor units can hold."""
    return F.bround(F.try_multiply(number, F.lit(100))).try_cast("bigint")


def parse_amount(value: Column | str, decimal_comma: Column | bool) -> Column:
    """Minor units of an amount cell; null when empty or unreadable (see ``amount_error``)."""
    return to_cents(amount_text(value, decimal_comma).try_cast(AMOUNT_TYPE))


def amount_error(value: Column | str, decimal_comma: Column | bool) -> Column:
    """True when the cell holds something that is not an amount, or one too large for minor units."""
    text = amount_text(value, decimal_comma)
    return text.isNotNull() & to_cents(text.try_cast(AMOUNT_TYPE)).isNull()


def _usual_date(text: Column, fmt: str) -> Column:
    """A usual format, whose shape and pattern are part of the plan."""
    parts = re.split("(%.)", fmt)
    shape = "".join(_SHAPE.get(p, re.escape(p)) for p in parts)
    return F.when(text.rlike(f"^{shape}$"), F.try_to_date(text, "".join(_SPARK_FIELD.get(p, p) for p in parts)))


def _spelled_out(fmt: Column) -> Column:
    for short, long in COMPOSED.items():
        fmt = F.replace(fmt, F.lit(short), F.lit(long))
    return fmt


def date_format_known(fmt: Column) -> Column:
    """Whether every directive of a format can be read, and none occurs twice."""
    used = F.regexp_extract_all(_spelled_out(fmt), F.lit(DIRECTIVE), F.lit(0))
    named = F.filter(used, lambda d: d != "%%")
    unknown = F.array_except(used, F.array(*map(F.lit, [*DIRECTIVES, "%%"])))
    return (F.size(unknown) == 0) & (F.size(named) == F.size(F.array_distinct(named)))


def date_reader(fmt: Column) -> Column:
    """A format as data: the pattern that a cell must have, with a group per directive, and the directives in order.

    Formats belong to profiles, so this is worked out once per document and not per row. A blank of the format stands for any
    white space, letters count in either case, and a cell that the first match does not use up is not read.
    """
    pieces = F.regexp_extract_all(_spelled_out(fmt), F.lit(r"(?s)%.|\s+|[^%\s]+"), F.lit(0))
    known = F.create_map(*[F.lit(x) for d, p in DIRECTIVES.items() for x in (d, f"({p})")])

    def pattern(piece: Column) -> Column:
        literal = F.concat(F.lit(r"\Q"), F.replace(piece, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        return F.when(piece == "%%", "%").when(piece.startswith("%"), F.try_element_at(known, piece)).when(piece.rlike(r"^\s"), r"\s+").otherwise(literal)

    whole = F.concat(F.lit("(?i)^(?>"), F.array_join(F.transform(pieces, pattern), ""), F.lit(r")\z"))
    return F.struct(whole.alias("pattern"), F.filter(pieces, lambda p: p.startswith("%") & (p != "%%")).alias("directives"))


def _read_date(text: Column, reader: Column) -> Column:
    """The date of a cell by one reader; what the format leaves out is January, the first, 1900."""

    def place(directive: str) -> Column:
        return F.array_position(reader["directives"], F.lit(directive)).cast("int")

    def part(directive: str) -> Column:
        return F.when(place(directive) > 0, F.call_function("regexp_extract", text, reader["pattern"], place(directive)))

    def last(values: dict[str, Column]) -> Column:
        """Of directives for the same thing the last one counts."""
        found = [F.when(place(d) > 0, F.struct(place(d).alias("at"), v.alias("value"))) for d, v in values.items()]
        return F.array_max(F.array(*found))["value"]

    number = lambda d: F.trim(part(d)).cast("int")
    named = lambda d, names: F.array_position(F.array(*map(F.lit, names)), F.lower(part(d))).cast("int")
    short = number("%y")
    year = F.coalesce(last({"%Y": number("%Y"), "%y": short + F.when(short <= PIVOT, 2000).otherwise(1900)}), F.lit(1900))
    months = {"%m": number("%m"), "%B": named("%B", MONTHS), "%b": named("%b", [m[:3] for m in MONTHS])}
    month = F.coalesce(last(months), F.lit(1))
    ymd = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month.cast("string"), F.coalesce(number("%d"), F.lit(1)).cast("string"))
    first = F.try_to_date(F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-1-1")), "yyyy-M-d")
    day = F.coalesce(F.date_add(first, number("%j") - 1), F.try_to_date(ymd, "yyyy-M-d"))
    return F.when(F.rlike(text, reader["pattern"]) & (year > 0), day)


def parse_date(value: Column | str, formats: Sequence[str] | Column, readers: Column | None = None) -> Column:
    """First format that reads the cell. ``formats`` is a fixed list or an array column.

    ``readers`` may hold the formats as :func:`date_reader` gives them, if they were worked out before.
    """
    text = strip(value)
    usual = F.coalesce(*[_usual_date(text, fmt) for fmt in USUAL_FORMATS])
    if not isinstance(formats, Column):
        if list(formats) == USUAL_FORMATS:
            return usual
        formats = F.array(*map(F.lit, formats))
    if readers is None:
        readers = F.transform(formats, date_reader)
    # most profiles name the same two; any other list is tried in its order, however long
    read = F.filter(F.transform(readers, lambda r: _read_date(text, r)), lambda d: d.isNotNull())
    # the two never read the same cell, so their order does not count; only a blank before a day of one digit and the year 0
    # are left to the readers
    turned = (formats == F.array(*map(F.lit, USUAL_FORMATS[::-1]))) & ~F.contains(text, F.lit(" ")) & ~F.contains(text, F.lit("0000"))
    return F.when((formats == F.array(*map(F.lit, USUAL_FORMATS))) | turned, usual).otherwise(F.get(read, F.lit(0)))


def is_pending(posting_text: Column | str) -> Column:
    return F.coalesce(F.upper(as_column(posting_text)).rlike(PENDING_MARKERS), F.lit(False))


def signed_amount(credit: Column | str, debit: Column | str, amount: Column | str) -> Column:
    """Credits count up, debits count down, else the amount column as it stands."""
    c, d, a = as_column(credit), as_column(debit), as_column(amount)
    return F.when(c != 0, F.abs(c)).when(d != 0, -F.abs(d)).otherwise(a)


def currency_code(value: Column | str, default: Column) -> Column:
    return F.coalesce(F.upper(blank_to_null(value)), default)


def compact_iban(value: Column | str) -> Column:
    return F.nullif(F.replace(as_column(value), F.lit(" "), F.lit("")), F.lit(""))


def cents_to_amount(cents: Column | str) -> Column:
    return (as_column(cents).cast("decimal(20,2)") / F.lit(100)).cast("decimal(20,2)")
