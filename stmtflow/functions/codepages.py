"""One-byte code pages as data: what each of the upper 128 bytes stands for.

The pages are those of the driver's Python, found by rule: every codec that is a table of 256 characters and leaves
ASCII as it is (so line ends, delimiters and quotes are the same bytes in all of them).
"""

from __future__ import annotations

import importlib
import pkgutil
import re
from encodings import aliases
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of encodings that are read as UTF-8, and of the two tables that the codecs state in another way.
UTF8_NAMES = ["utf_8_sig", "utf_8", "utf8", "u8", "utf", "cp65001"]
PLAIN = ["latin_1", "ascii"]
UPPER = "".join(map(chr, range(128, 256)))
#: Stands for a byte that a page does not define.
NONE = "\ufffe"


@lru_cache(maxsize=1)
def pages() -> dict[str, str]:
    """Name (lower case, with underscores) to the characters of the bytes from 128 on."""
    import encodings

    tables = {"latin_1": UPPER, "ascii": NONE * 128}
    for module in pkgutil.iter_modules(encodings.__path__):
        table = None if module.name in PLAIN or module.name in ("mbcs", "oem") else getattr(importlib.import_module(f"encodings.{module.name}"), "decoding_table", None)
        if table is not None and table[:128] == "".join(map(chr, range(128))):
            tables[module.name] = table[128:].ljust(128, NONE)
    names = {re.sub("[^a-z0-9]+", "_", name.lower()): tables[codec] for name, codec in aliases.aliases.items() if codec in tables}
    return names | tables


def normal_name(encoding: Column) -> Column:
    return F.regexp_replace(F.lower(encoding), "[^a-z0-9]+", "_")


def is_utf8(encoding: Column) -> Column:
    return normal_name(encoding).isin(UTF8_NAMES)


def page_of(encoding: Column) -> Column:
    """The characters of an encoding's upper bytes; null if it is no known one-byte page."""
    names = F.split(F.lit("\x02".join(pages())), "\x02")
    tables = F.split(F.lit("\x02".join(pages().values())), "\x02")
    return F.get(tables, F.array_position(names, normal_name(encoding)).cast("int") - 1)


def gaps_of(page: Column) -> Column:
    """The upper characters of ISO-8859-1 whose bytes a page does not define; null without a page."""
    return F.when(page.isNotNull(), F.filter(F.split(F.lit(UPPER), ""), lambda c, i: F.substr(page, i + 1, F.lit(1)) == NONE))


def decoded(latin1: Column, page: Column) -> Column:
    """Text of bytes that were read as ISO-8859-1; undefined bytes give ``NONE``."""
    return F.call_function("translate", latin1, F.lit(UPPER), page)
