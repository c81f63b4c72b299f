"""Texts of structured game records: inline tags, nested blocks and record formats."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.cleaning import ordinal

_tag = re.compile(r"\{@(\w+)\s*([^}]*)\}")
# Names of attacks, and the templates of tags with and without a first argument.
ATTACKS = {"mw": "Melee Weapon Attack:", "rw": "Ranged Weapon Attack:", "ms": "Melee Spell Attack:", "rs": "Ranged Spell Attack:"}
TEMPLATES = {"h": ("Hit: ", "Hit: "), "hit": ("+{}", ""), "dc": ("DC {}", "DC"), "recharge": ("(Recharge {}-6)", "(Recharge 6-6)"), "chance": ("{}%", "")}
LAST = frozenset({"scaledamage", "scaledice"})


def _resolved(m: re.Match) -> str:
    name, raw = m[1], m[2]
    parts = [p.strip() for p in raw.split("|")]
    if name in TEMPLATES:
        return TEMPLATES[name][0 if parts[0] else 1].format(parts[0])
    if name == "atk":
        return " or ".join(ATTACKS.get(c.strip(), c.strip()) for c in parts[0].split(",")) if parts[0] else ""
    return parts[-1] if name in LAST else parts[0] or raw


def resolve(text: str) -> str:
    return _tag.sub(_resolved, text)


def block_lines(block: object) -> list[str]:
    """The lines of a text, list, table or nested block."""
    if isinstance(block, str):
        return [resolve(block)]
    if not isinstance(block, dict):
        return []
    kind, name = block.get("type"), block.get("name")
    if kind == "table":
        rows = ([[block["caption"]]] if block.get("caption") else []) + ([block["colLabels"]] if block.get("colLabels") else []) + list(block.get("rows", []))
        return [" | ".join(resolve(str(c)) for c in (r if isinstance(r, list) else [r])) for r in rows]
    if kind == "list":
        out: list[str] = []
        for item in block.get("items", []):
            if isinstance(item, str):
                out.append("- " + resolve(item))
            elif isinstance(item, dict) and "entry" in item:
                out.append("- " + ": ".join(filter(None, [item.get("name"), resolve(str(item["entry"]))])))
            elif isinstance(item, dict) and "entries" in item:
                out += ["- " + item["name"]] if item.get("name") else []
                out += [x for sub in item["entries"] for x in block_lines(sub)]
            elif isinstance(item, dict):
                out += block_lines(item)
        return out
    inner = block["entries"] if "entries" in block else [str(block["entry"])] if "entry" in block else []
    return ([str(name)] if name else []) + [x for sub in inner for x in block_lines(sub)]


@F.pandas_udf(T.StringType())
def resolve_tags(texts: pd.Series) -> pd.Series:
    """Texts with `{@tag a|b}` written out."""
    return texts.map(lambda t: None if t is None else resolve(t))


@F.pandas_udf(T.StringType())
def render_blocks(entries: pd.Series) -> pd.Series:
    """A JSON array of blocks as lines of text; null where it isn't JSON."""

    def one(t: str | None) -> str | None:
        try:
            return "\n".join(x for block in json.loads(t or "null") or [] for x in block_lines(block))
        except (ValueError, TypeError):
            return None

    return entries.map(one)


def is_free(*flags: Column) -> Column:
    """Whether any of an entry's licence flags is set."""
    return F.greatest(*[F.coalesce(f.cast("boolean"), F.lit(False)) for f in flags])


def labelled(pairs: list[tuple[str, Column]]) -> Column:
    """`Label: value` of the values that aren't empty, joined by bars."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{label}: "), F.coalesce(c.cast("string"), F.lit(""))) for label, c in pairs])


def monster_text(name: Column, facts: list[tuple[str, Column]], defences: list[tuple[str, Column]], extras: list[tuple[str, Column]]) -> Column:
    """Heading, two lines of labelled facts, and a line for every further fact that is there."""
    more = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}: "), c.cast("string"))) for label, c in extras]
    return F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce(name, F.lit("Unknown"))), labelled(facts), labelled(defences), *more)


def spell_meta(level: Column, school: Column) -> Column:
    """Category, level in words and school, a line each."""
    words = F.when(level == 0, "Cantrip").otherwise(F.concat(ordinal(level), F.lit("-level")))
    return F.concat_ws("\n", F.lit("Category: spell"), F.concat(F.lit("Level: "), words), F.concat(F.lit("School: "), F.coalesce(school, F.lit(""))))


@F.pandas_udf(T.StringType())
def generic_text(records: pd.Series) -> pd.Series:
    """A JSON object as heading and lines of its texts and lists, without the fields of its source document."""

    def one(t: str | None) -> str | None:
        try:
            record = json.loads(t or "null")
        except ValueError:
            return None
        if not isinstance(record, dict):
            return None
        out = ["# " + str(record.get("name", record.get("slug", "Unknown")))]
        for key, v in record.items():
            if key in ("name", "slug") or key.startswith("document__"):
                continue
            shown = v.strip() if isinstance(v, str) else ", ".join(map(str, v)) if isinstance(v, list) else ""
            if shown:
                out.append(f"{key.replace('_', ' ').capitalize()}: {shown}")
        return "\n".join(out)

    return records.map(one)
