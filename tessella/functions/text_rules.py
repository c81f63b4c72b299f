"""One meaning of white space, letters, words and lines for columns; it is the meaning that Python's str has.

Java's own classes are ASCII or differ on digits and separators, so every rule spells its class out.
"""

from __future__ import annotations

import sys
from functools import cache
from itertools import chain
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside of a character class: the code points for which Python's str.isspace holds.
SPACE = r"\x09-\x0d\x1c-\x20\x85\p{Z}"
#: Code points that end a line for str.splitlines, without CR LF as a pair.
LINE_END = r"\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}"
#: What \w means in Python.
WORD_CHAR = r"\p{L}\p{N}_"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


@cache
def _upper_forms() -> tuple[str, str]:
    """All characters that have an upper form of one character, and these forms."""
    pairs = []
    for c in map(chr, chain(range(0x80, 0xD800), range(0xE000, sys.maxunicode + 1))):
        forms = [x for x in ("\u1e9e" if c == "\u00df" else "", c.upper(), c.title()) if len(x) == 1]
        if forms and forms[0] != c:
            pairs.append((c, forms[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def upper(c: Column) -> Column:
    """In capitals, character by character, so that no text gets longer; Java's rule writes sharp s and ligatures as several."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(F.translate(c, ascii_lowercase, ascii_uppercase), *_upper_forms())).otherwise(F.upper(c))


def lines(c: Column) -> Column:
    """The lines of a text, none for an empty one; the end of the last line doesn't open another."""
    parts = F.split(F.regexp_replace(c, "\r\n", "\n"), f"[{LINE_END}]")
    return F.when(c == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def tokens(c: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda x: x != "")


def blank(c: Column) -> Column:
    return strip(c) == ""


def char_count(c: Column, keep: str) -> Column:
    """Number of characters of `c` that lie in the character class `keep`."""
    return F.length(F.regexp_replace(c, f"[^{keep}]", ""))


def runs(items: Column, n: int) -> Column:
    """All runs of n neighbouring elements as structs with fields r0, r1, ..; none for a shorter array.

    Slices are zipped, so the array is built once per slice.  A lambda that indexes into the array would have the
    optimizer move the array's own expression into the lambda and build it anew for every element.
    """
    count = F.size(items) - (n - 1)
    width = F.greatest(count, F.lit(0))
    return F.arrays_zip(*[F.slice(items, k + 1, width).alias(f"r{k}") for k in range(n)])
