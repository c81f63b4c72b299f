"""The registry of agents: its entries are read from JSON and checked before any of them is used."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

#: Fields an entry must have (fixed value).
REQUIRED = ("display_name", "checkpoint", "vocab")


def entry_error(entry: object) -> str | None:
    """What is wrong with an entry; None if it can be used."""
    if not isinstance(entry, dict):
        return "not an object"
    lacking = [f for f in REQUIRED if f not in entry]
    if lacking:
        return f"no {lacking[0]}"
    if entry.get("corrective_retry") and not entry.get("crag"):
        return "corrective_retry needs crag"
    return None


def parse_registry(text: str) -> dict[str, dict]:
    """The entries by key, in their order; broken JSON and the first bad entry are a ValueError that names it."""
    try:
        entries = json.loads(text)
    except ValueError as x:
        raise ValueError(f"the registry isn't JSON: {x}") from x
    if not isinstance(entries, dict):
        raise ValueError("the registry isn't an object")
    for key, entry in entries.items():
        if error := entry_error(entry):
            raise ValueError(f"agent {key!r}: {error}")
    return entries


def registry_table(spark: SparkSession, text: str) -> DataFrame:
    """(place, agent, display_name, corpus_dirs, crag, corrective_retry, error) of all entries, bad ones included."""
    rows = []
    for place, (key, e) in enumerate(json.loads(text).items()):
        fine = e if isinstance(e, dict) else {}
        rows.append((place, key, fine.get("display_name"), [str(x) for x in fine.get("corpus_dirs", [])], bool(fine.get("crag", False)), bool(fine.get("corrective_retry", False)), entry_error(e)))
    return spark.createDataFrame(rows, "place int, agent string, display_name string, corpus_dirs array<string>, crag boolean, corrective_retry boolean, error string")
