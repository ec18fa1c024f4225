"""Keep account numbers and customer numbers out of reports and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stmtflow.functions.text import as_column, squeeze

# Fixed values.
IBAN_IN_TEXT = r"(?U)\b([A-Z]{2}\d{2})[A-Z0-9 ]{11,30}?([A-Z0-9]{4})\b"
DIGIT_RUN = r"(?U)\d{3,}"
SNIPPET_LENGTH = 60
SHORT_IBAN = "****"


def mask_iban(value: Column | str) -> Column:
    compact = F.replace(F.coalesce(as_column(value), F.lit("")), F.lit(" "), F.lit(""))
    return (
        F.when(F.coalesce(as_column(value), F.lit("")) == "", F.lit(""))
        .when(F.char_length(compact) < 8, F.lit(SHORT_IBAN))
        .otherwise(F.concat(F.left(compact, F.lit(4)), F.lit("…"), F.right(compact, F.lit(4))))
    )


def mask_text(value: Column | str) -> Column:
    return F.regexp_replace(as_column(value), IBAN_IN_TEXT, "$1…$2")


def mask_snippet(value: Column | str) -> Column:
    hidden = F.regexp_replace(F.coalesce(as_column(value), F.lit("")), DIGIT_RUN, "#")
    return F.left(squeeze(hidden), F.lit(SNIPPET_LENGTH))
