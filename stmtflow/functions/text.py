"""Text helpers with Unicode semantics: whitespace, NFKC, case folding, ASCII test."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stmtflow.functions import unicode

# every character that counts as whitespace in Unicode, plus the four ASCII separators
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
WHITESPACE_ANY = f"{unicode.character_class(set(WHITESPACE))}+"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Trim all Unicode whitespace (``trim`` alone only removes blanks)."""
    return F.btrim(as_column(value), F.lit(WHITESPACE))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(strip(value), F.lit(""))


# Whole matches are loops over a text; a search for a character that is not of a class costs a call per place, many times as much.
# texts whose characters all lie here keep them under NFKC, and both engines change their case alike
WESTERN = "\\A[\t-\r\x1c-\x1f -~À-ÖØ-öø-ÿ]*\\z"
WESTERN_SPACE_RUN = "[\t-\r\x1c-\x1f ]+"
PRINTABLE = r"\A[ -~]*\z"
WESTERN_LINE = "\\A[ -~À-ÖØ-öø-ÿ]*\\z"


def only_blanks(c: Column) -> Column:
    """True for texts whose white space is surely blanks alone: those of printable western letters and signs."""
    return c.rlike(WESTERN_LINE)


def _eastern(c: Column) -> Column:
    return ~c.rlike(WESTERN)


def _plain(c: Column) -> Column:
    """Printable ASCII without two blanks in a row, which is its own normal form but for case and ends."""
    return c.rlike(PRINTABLE) & ~F.contains(c, F.lit("  "))


def _by_script(c: Column, simple: Column, general: Callable[[Column], Column]) -> Column:
    """``simple`` where it holds, and ``general`` for texts with other characters; both on the JVM."""
    return F.when(_eastern(c), general(c)).otherwise(simple)


def casefold(value: Column | str) -> Column:
    """Full Unicode case folding; for ASCII that is ``lower``."""
    c = as_column(value)
    return _by_script(c, F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), unicode.casefold)


def squeeze(value: Column) -> Column:
    """Whitespace runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(value, WHITESPACE_RUN, " "))


def _squeeze_western(text: Column) -> Column:
    """``squeeze`` of a text without eastern characters, whose whitespace is that of a short list."""
    return F.when(_plain(text), F.trim(text)).otherwise(F.trim(F.regexp_replace(text, WESTERN_SPACE_RUN, " ")))


def _norm_any(text: Column) -> Column:
    return unicode.upper(F.trim(F.regexp_replace(unicode.nfkc(text), WHITESPACE_ANY, " ")))


def norm(value: Column | str) -> Column:
    """Comparison form of a statement text: NFKC, one blank between words, upper case.

    Deterministic, so filters pass it, and without Python workers. What it gives is stored in keys: it follows the Unicode
    version of the driver's Python (``unicode.version``), and an upgrade of that is an upgrade of the stored keys.
    """
    c = F.coalesce(as_column(value), F.lit(""))
    return F.when(_plain(c), F.upper(F.trim(c))).when(_eastern(c), _norm_any(c)).otherwise(F.upper(_squeeze_western(c)))


def norm_joined(values: list[Column], separator: str) -> Column:
    """The texts' comparison forms with ``separator`` (white space itself, so none of them holds it) between them.

    Looked at together, as most rows are plain: those cost one match and no regular replacement.
    """
    texts = [F.coalesce(v, F.lit("")) for v in values]
    trimmed = [F.trim(t) for t in texts]
    together = F.concat(*trimmed)
    return (
        F.when(_plain(together), F.upper(F.concat_ws(separator, *trimmed)))
        .when(~_eastern(together), F.upper(F.concat_ws(separator, *[_squeeze_western(t) for t in texts])))
        .otherwise(F.array_join(F.transform(F.array(*texts), _norm_any), separator))
    )


def loose_key(value: Column | str) -> Column:
    """Key that ignores case, spacing and punctuation."""
    c = F.coalesce(as_column(value), F.lit(""))
    return F.trim(F.regexp_replace(casefold(c), "[^a-z0-9äöüß]+", " "))
