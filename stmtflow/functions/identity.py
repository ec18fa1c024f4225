"""Content identity of a statement row: canonical text, key, fingerprint, import id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stmtflow.functions.text import as_column, norm_joined, strip

# Part of every stored key.
KEY_VERSION = "v1"
SEPARATOR = "\x1f"
IMPORT_ID_LENGTH = 32
UNKNOWN_PAYEE = "Unknown payee"


def joined(*parts: Column) -> Column:
    # concat_ws leaves nulls out, which would shift the fields
    return F.concat_ws(SEPARATOR, *[F.coalesce(p, F.lit("")) for p in parts])


def canonical_text() -> Column:
    """What makes two rows of one document the same booking. The value date is not part of it."""
    reference = F.coalesce(
        F.nullif(F.col("end_to_end_id"), F.lit("")), F.col("bank_reference")
    )
    return joined(
        F.lit(KEY_VERSION),
        F.col("account_ref"),
        F.col("booking_date").cast("string"),
        F.col("amount_cents").cast("string"),
        F.upper("currency"),
        norm_joined([reference, *map(F.col, ("counterpart_iban", "counterpart_name", "purpose", "posting_text"))], SEPARATOR),
    )


def source_key(canonical: Column | str, ordinal: Column | str) -> Column:
    return F.sha2(joined(as_column(canonical), as_column(ordinal).cast("string")), 256)


def fingerprint() -> Column:
    """Changes whenever the bank shows the same booking in another way."""
    return F.sha2(
        joined(
            F.col("booking_date").cast("string"),
            F.col("value_date").cast("string"),
            F.col("amount_cents").cast("string"),
            F.col("currency"),
            F.col("counterpart_name"),
            F.col("counterpart_iban"),
            F.col("purpose"),
            F.col("posting_text"),
            F.col("bank_reference"),
            F.col("end_to_end_id"),
        ),
        256,
    )


def is_digest(value: Column | str) -> Column:
    return as_column(value).rlike("\\A[0-9a-f]{64}\\z")


def packed(digest: Column | str) -> Column:
    """The text as bytes, a digest in hex in half as many; equal exactly for equal texts."""
    value = as_column(digest)
    return F.when(is_digest(value), F.concat(F.lit(b"\x01"), F.unhex(value))).otherwise(
        F.concat(F.lit(b"\x00"), value.cast("binary"))
    )


def unpacked(value: Column | str) -> Column:
    value = as_column(value)
    rest = F.substring(value, 2, 0x7FFFFFFF)
    return F.when(F.substring(value, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def packed_tail(value: Column | str) -> Column:
    """The text as bytes, a tail of ``IMPORT_ID_LENGTH`` hex digits in half as many; equal exactly for equal texts."""
    value = as_column(value)
    tail = F.right(value, F.lit(IMPORT_ID_LENGTH))
    head = F.left(value, F.char_length(value) - IMPORT_ID_LENGTH).cast("binary")
    return F.when(
        tail.rlike(f"\\A[0-9a-f]{{{IMPORT_ID_LENGTH}}}\\z"), F.concat(F.lit(b"\x01"), F.unhex(tail), head)
    ).otherwise(F.concat(F.lit(b"\x00"), value.cast("binary")))


def imported_id(source_id: Column | str, key: Column | str) -> Column:
    return F.concat(as_column(source_id), F.lit(":"), F.left(as_column(key), F.lit(IMPORT_ID_LENGTH)))


def payee_name(
    counterpart: Column | str = "counterpart_name", posting: Column | str = "posting_text"
) -> Column:
    empty = F.lit("")
    return strip(
        F.coalesce(
            F.nullif(as_column(counterpart), empty),
            F.nullif(as_column(posting), empty),
            F.lit(UNKNOWN_PAYEE),
        )
    )
