"""Names and search text."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters that disqualify a name.
SPECIAL_CHARACTERS = r"""[~!@#$^%&*_+={}\[\]|;:"'<,>.?`/\\]"""

# Fixed value: what may stand at the end of a name to tell it from others.
DISAMBIGUATOR = r"[\s\(\d\)]*$"


def _plain_letters() -> tuple[str, str]:
    """All characters whose canonical decomposition holds an ASCII character, and that character."""
    letters, plain = [], []
    for point in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= point < 0xE000:
            kept = unicodedata.normalize("NFD", chr(point)).encode("ascii", "ignore").decode("ascii")
            if kept:
                letters.append(chr(point))
                plain.append(kept)
    return "".join(letters), "".join(plain)


_LETTERS, _PLAIN = _plain_letters()


def strip_accents(c: Column) -> Column:
    """Canonical decomposition, then only the ASCII characters stay (F1).

    Decomposing goes character by character and at most one ASCII character comes out
    of each, so it is one translation by a table, made above by that rule.
    """
    return F.regexp_replace(F.translate(c, _LETTERS, _PLAIN), r"[^\x00-\x7F]", "")


def strip_punctuation(c: Column) -> Column:
    """Remove ASCII punctuation (F2)."""
    return F.regexp_replace(c, r"\p{Punct}", "")


def search_form(name: Column) -> Column:
    """Text a search term is matched against: no punctuation, lower case, no accents."""
    return strip_accents(F.lower(strip_punctuation(name)))


def file_form(name: Column) -> Column:
    """Accent-free, trimmed, whitespace as underscores."""
    return F.regexp_replace(F.trim(strip_accents(name)), r"\s+", "_")


def spaced(c: Column) -> Column:
    """Underscores as spaces."""
    return F.translate(c, "_", " ")


def has_special_characters(name: Column) -> Column:
    return name.rlike(SPECIAL_CHARACTERS)


def display_name(name: Column) -> Column:
    """Name without a trailing disambiguator such as "(2)" (F30); plain digits at the end go, too."""
    return F.regexp_replace(name, DISAMBIGUATOR, "")


def html_escape(c: Column) -> Column:
    """Escape & " < >."""
    for plain, escaped in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def escaped_name(c: Column) -> Column:
    """Trimmed, lower-cased, escaped and without ideographic spaces."""
    return F.replace(html_escape(F.lower(F.trim(c))), F.lit("　"), F.lit(""))
