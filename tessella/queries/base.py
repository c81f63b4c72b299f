"""Helpers of the query modules."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.runtime import spread

#: White space as a character class in DuckDB's regular expressions, equal to text_rules.SPACE.
WS = r"\x09-\x0d\x1c-\x20\x{85}\p{Z}"
EOL = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda w: w <> '')"


def sql_lines(x: str) -> str:
    parts = f"regexp_split_to_array(replace({x}, chr(13) || chr(10), chr(10)), '[{EOL}]')"
    return f"(CASE WHEN {x} = '' THEN [] WHEN {parts}[-1] = '' THEN {parts}[1:len({parts}) - 1] ELSE {parts} END)"


def sql_chain(x: str, rules: list[tuple[str, str]]) -> str:
    """The same replacements in DuckDB: its replacement groups are written with backslashes, its flags as an option."""
    from tessella.functions.text_rules import SPACE

    for pattern, to in rules:
        flags = "g"
        if pattern.startswith("(?"):
            inside, _, pattern = pattern[2:].partition(")")
            # RE2: m is line mode, s lets the dot match line ends
            pattern = f"(?{inside}){pattern}"
        pattern = pattern.replace(SPACE, WS).replace("'", "''")
        to = to.replace("$1", r"\1").replace("$2", r"\2").replace("\n", "' || chr(10) || '")
        x = f"regexp_replace({x}, '{pattern}', '{to}', '{flags}')"
    return x


@cache
def _compatible() -> str:
    """Every character that compatibility composition changes, with what it becomes, by the Unicode tables."""
    hexed = lambda x: "".join(f"chr({ord(c)})||" for c in x)[:-2]
    got = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x80, 0x2FA20) if not 0xD800 <= c < 0xE000)
    return ", ".join(f"({hexed(k)}, {hexed(v)})" for k, v in got if k != v)


def sql_nfkc(rows: str) -> str:
    """CTEs ending in c(doc_id, t): the texts of `rows`(doc_id, t) in compatibility composition.

    Each character is replaced by its own composition, and the whole is composed canonically.
    """
    return f"""m(k, v) AS (VALUES {_compatible()}), s0 AS (SELECT doc_id, t FROM {rows}),
      x AS (SELECT doc_id, unnest(l) AS ch, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '(?s).') AS l FROM s0 WHERE regexp_matches(t, '[^\\x00-\\x7F]'))),
      y AS (SELECT doc_id, nfc_normalize(string_agg(coalesce(v, ch), '' ORDER BY i)) AS t FROM x LEFT JOIN m ON ch = k GROUP BY doc_id),
      c AS (SELECT s0.doc_id, coalesce(y.t, s0.t) AS t FROM s0 LEFT JOIN y ON y.doc_id = s0.doc_id)"""
