"""Cleaning of extracted texts, stripping of markup, file names and small formats, all as column expressions.

Null stays null everywhere; an empty text stays empty.
"""

from __future__ import annotations

import unicodedata
from enum import Enum

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text_rules import SPACE, blank, lines, strip, tokens


class Cleaning(str, Enum):
    MINIMAL = "minimal"
    STANDARD = "standard"
    THOROUGH = "thorough"


#: Words that a line must have to survive thorough cleaning (fixed value).
LEAST_WORDS = 4


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition; Spark has no function for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def collapse(c: Column) -> Column:
    """At most one blank line in a row, runs of spaces and tabs as one space."""
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), "[ \t]+", " ")


def drop_thin_lines(c: Column) -> Column:
    """Without lines of one to three words; blank lines stay."""
    kept = F.filter(lines(c), lambda x: (F.size(tokens(x)) >= LEAST_WORDS) | blank(x))
    return F.array_join(kept, "\n")


def drop_repeated_paragraphs(c: Column) -> Column:
    """Without paragraphs that equal, at their edges trimmed, the paragraph before."""
    parts = F.split(c, "\n\n")
    before = F.concat(F.array(F.lit(None).cast("string")), parts)
    pairs = F.arrays_zip(parts.alias("x"), F.slice(before, 1, F.size(parts)).alias("y"))
    kept = F.filter(pairs, lambda z: z["y"].isNull() | (strip(z["x"]) != strip(z["y"])))
    return F.array_join(F.transform(kept, lambda z: z["x"]), "\n\n")


def clean(c: Column, level: Cleaning = Cleaning.STANDARD, normalize: bool = True) -> Column:
    """A text cleaned at `level`.  `normalize=False` leaves Unicode as it is and stays inside the JVM."""
    text = strip(nfkc(c) if normalize else c)
    if level is Cleaning.MINIMAL:
        return text
    text = collapse(text)
    if level is Cleaning.THOROUGH:
        text = drop_repeated_paragraphs(drop_thin_lines(text))
        text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return strip(text)


def _chain(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


# The markup patterns below decide what is stripped and in which order.
MARKDOWN = [
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (rf"(?m)^#{{1,6}}[{SPACE}]+", ""),
    (r"[*_]{1,3}([^*_]+)[*_]{1,3}", "$1"),
    (r"`([^`]*)`", "$1"),
    (r"(?ms)^```[^\n]*\n(.*?)^```", "$1"),
    (rf"(?m)^[-*_]{{3,}}[{SPACE}]*$", ""),
    (rf"(?m)^>[{SPACE}]?", ""),
]
WIKITEXT = [
    (r"\{\{[^{}]*\}\}", ""),
    (r"\{\{[^{}]*\}\}", ""),
    (r"(?i)\[\[(?:File|Image):[^\]]*\]\]", ""),
    (r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]", "$1"),
    (rf"\[https?://[^{SPACE}]+[{SPACE}]+([^\]]+)\]", "$1"),
    (rf"\[https?://[^{SPACE}]+\]", ""),
    (r"<[^>]+>", ""),
    (rf"(?m)^[{SPACE}]*[|!{{].*$", ""),
    (rf"=+[{SPACE}]*(.+?)[{SPACE}]*=+", "$1"),
    (r"'{2,3}", ""),
    (r"\n{3,}", "\n\n"),
]
WIKI_REMNANTS = [(r"(?i)\[\s*edit\s*\]", ""), (r"\{\{[^}]*\}\}", ""), (r"\[\[([^\]|]+\|)?([^\]]+)\]\]", "$2"), (r"\n{3,}", "\n\n")]
WIKI_NAVIGATION = [(rf"(?m)^(Previous|Next|Back|Home|Contents|Navigation)[{SPACE}]*:.*$", "")]
QA_SCAFFOLD = [
    (r"(?m)^Tags: .*\n?", ""),
    (r"(?m)^Score: -?[0-9]+\n?", ""),
    (r"(?m)^## .*\(score: -?[0-9]+\)[ \t\n\r]*\n?", ""),
    (r"(?m)^---\n?", ""),
    (r"(?m)^# (.+)$", "$1"),
    (r"\n{3,}", "\n\n"),
]
SCANNED_PAGES = [
    (r"\x0c", "\n\n"),
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""),
    (r"(?im)^[ \t]*(DRAGON|DUNGEON|TSR|WIZARDS? OF THE COAST|PAIZO)[ \t0-9]*$", ""),
    (r"(?m)^[ \t\n]*[0-9]{1,4}[ \t\n]*$", ""),
    (r"[-─═━]{5,}", ""),
    (r"\n{3,}", "\n\n"),
]
BOOK_START = r"(?is)^.*?\*{3}\s*START OF (?:THE |THIS )?PROJECT GUTENBERG.*?\*{3}"
BOOK_END = r"(?is)\*{3}\s*END OF (?:THE |THIS )?PROJECT GUTENBERG.*$"


def unix_lines(c: Column) -> Column:
    """CR LF as LF: `$` and `.` then see the same ends of lines in Java as elsewhere."""
    return F.regexp_replace(c, "\r\n?", "\n")


def strip_markdown(c: Column) -> Column:
    return _chain(c, MARKDOWN)


def strip_wikitext(c: Column) -> Column:
    return strip(_chain(c, WIKITEXT))


def strip_wiki_remnants(c: Column) -> Column:
    return strip(_chain(c, WIKI_REMNANTS))


def strip_wiki_navigation(c: Column) -> Column:
    return _chain(c, WIKI_NAVIGATION)


def strip_qa_scaffold(c: Column) -> Column:
    """Without tags, scores, answer headings, rules and heading marks of a question dump; ends with one line end."""
    return F.concat(strip(_chain(c, QA_SCAFFOLD)), F.lit("\n"))


def clean_scanned_pages(c: Column) -> Column:
    return strip(_chain(c, SCANNED_PAGES))


def strip_book_frame(c: Column) -> Column:
    """The text between the start and end marks of a public-domain book, where there are such."""
    return strip(_chain(c, [(BOOK_START, ""), (BOOK_END, ""), (r"\n{4,}", "\n\n\n")]))


def url_file_name(url: Column) -> Column:
    """A file stem from a URL: its path, or else its host, with unsafe characters as underscores, at most 128 long."""
    path = F.regexp_replace(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), "^/+|/+$", "")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    slug = F.when(path != "", F.regexp_replace(path, "/", "_")).when(host != "", host).otherwise("page")
    return F.substring(F.regexp_replace(slug, r"[^\p{L}\p{N}_\-.]", "_"), 1, 128)


def url_is_markdown(url: Column, content_type: Column | None = None) -> Column:
    """Whether a URL serves raw markdown, by its ending or its content type."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    by_name = path.rlike(r"\.(md|markdown)$")
    if content_type is None:
        return by_name
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return by_name | (kind.contains("text/plain") & ~kind.contains("html"))


def tag_words(c: Column) -> Column:
    """`<a><b>` as `a b`."""
    return F.array_join(F.regexp_extract_all(c, F.lit("<([^>]+)>"), F.lit(1)), " ")


def pipe_table(rows: Column) -> Column:
    """An array of rows of cells as a Markdown table; '' where no row has a cell with text."""
    cell = lambda x: F.coalesce(F.nullif(strip(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" "))), F.lit("")), F.lit(" "))
    kept = F.filter(rows, lambda r: F.exists(r, lambda x: F.coalesce(x, F.lit("")) != ""))
    width = F.array_max(F.transform(kept, lambda r: F.size(r)))
    full = F.transform(kept, lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(" "), (width - F.size(r)).cast("int"))))
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width.cast("int")), " | "), F.lit(" |"))
    body = F.transform(F.slice(full, 2, F.greatest(F.size(full) - 1, F.lit(0))), row)
    return F.when(F.size(kept) == 0, "").otherwise(F.array_join(F.concat(F.array(row(F.get(full, F.lit(0)))), F.array(rule), body), "\n"))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, but 11th to 13th."""
    last, tens = F.pmod(n, F.lit(10)), F.pmod(n, F.lit(100))
    teen = (tens >= 10) & (tens <= 20)
    end = F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def challenge_rating(x: Column) -> Column:
    """0.125, 0.25 and 0.5 as fractions, whole numbers without a point."""
    whole = F.when(x == F.floor(x), F.floor(x).cast("string"))
    return F.when(x == 0.125, "1/8").when(x == 0.25, "1/4").when(x == 0.5, "1/2").otherwise(F.coalesce(whole, x.cast("string")))


def slug(c: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def glob_pattern(glob: str) -> str:
    """The regular expression of a file glob with * ? and [..]."""
    out = []
    i = 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            inner = glob[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]")
            i = close
        else:
            out.append("\\" + ch if ch in r"\.^$+{}()|[]/" else ch)
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def parse_weight_rules(text: str) -> list[tuple[str, float]]:
    """Lines `GLOB:WEIGHT`; blank lines and comments are skipped, the last colon separates."""
    rules = []
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            glob, colon, weight = line.rpartition(":")
            if not colon:
                raise ValueError(f"no weight in {line!r}")
            rules.append((glob.strip(), float(weight)))
    return rules


def weight_by_glob(name: Column, rules: list[tuple[str, float]], default: float = 1.0) -> Column:
    """The weight of the first glob that matches the name."""
    found = F.lit(None).cast("double")
    for glob, weight in reversed(rules):
        found = F.when(name.rlike(glob_pattern(glob)), F.lit(float(weight))).otherwise(found)
    return F.coalesce(found, F.lit(float(default)))
