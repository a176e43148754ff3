"""Text expressions with Python's Unicode rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 characters that Python's str.isspace holds for, and a Java character class of the same.
SPACES = "".join(filter(str.isspace, map(chr, range(0x3001))))
SPACE_CLASS = r"[\s\u0085\u001c-\u001f\p{Z}]"
#: The framed document's first and last id, and the id of byte 0 in the byte tokenizer.
BOS, EOS, BYTE_BASE = 1, 2, 7


def strip(text: Column) -> Column:
    """In time linear in the text, whatever runs of white space it has inside."""
    return F.trim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    """True for null too."""
    return F.coalesce(~text.rlike(f"[^{SPACE_CLASS[1:-1]}]"), F.lit(True))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")).cast("long")


def byte_ids(text: Column) -> Column:
    """The byte tokenizer: one id a UTF-8 byte; empty text has none."""
    return F.transform(F.regexp_extract_all(F.hex(text.cast("binary")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("int") + BYTE_BASE)


def framed(ids: Column) -> Column:
    return F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS)))


def python_capitalize(text: Column) -> Column:
    """The first character in upper case, all others in lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))
