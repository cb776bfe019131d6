"""Cleaning of typed text with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a blank: ASCII white space, no-break, typographic and ideographic spaces, and zero-width marks.
BLANK = r"[\s\u00A0\u1680\u2000-\u200F\u2028-\u202F\u205F-\u2064\u3000\uFEFF]"
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(map(chr, range(0x21, 0x7F)))


def half_width(c: Column) -> Column:
    """Full-width ASCII as ASCII, the ideographic space as a space, the wide currency signs as their narrow ones."""
    return F.translate(c, WIDE + "　￥￡", NARROW + " ¥£")


def no_blanks(c: Column) -> Column:
    return F.regexp_replace(c, BLANK + "+", "")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def is_blank(c: Column) -> Column:
    """True for null and for texts of blanks only."""
    return c.isNull() | (no_blanks(c) == "")


def clean_field(c: Column) -> Column:
    """A field's name without blanks and closing colons of either width."""
    return F.regexp_replace(no_blanks(c), "[:：]+$", "")


def same_value(c: Column) -> Column:
    """What two spellings of one value have in common: blanks removed, full width as half width."""
    return no_blanks(half_width(c))
