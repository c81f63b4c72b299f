"""Guards of generated token sequences: repetition loops, value grammars, and operations on logits."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def looping_tokens(ids: list[int], repeats: int = 3, longest: int = 4, match: float = 1.0) -> set[int]:
    """Tokens that would carry on a loop: a block of up to `longest` tokens that already ran `repeats` - 1 times.

    Per block length the last cycles form a matrix; its first column must be constant, and so must a share of `match`.
    """
    banned: set[int] = set()
    for period in range(1, longest + 1):
        span = period * (repeats - 1)
        if span and len(ids) >= span:
            cycles = np.asarray(ids[-span:]).reshape(repeats - 1, period)
            steady = (cycles == cycles[-1]).all(axis=0)
            if steady[0] and steady.mean() >= match:
                banned.add(int(cycles[-1, 0]))
    return banned


def loop_guard(ids: Column, repeats: int = 3, longest: int = 4, match: float = 1.0) -> Column:
    """The sorted looping tokens of an array of ids."""

    @F.pandas_udf("array<int>")
    def guard(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else sorted(looping_tokens(list(x), repeats, longest, match)))

    return guard(ids)


def integer_prefix(text: Column, most: int | None = None, commas: bool = False) -> Column:
    """Whether a text can start an integer, optionally with group commas and an upper bound."""
    shape = text.rlike(r"^[0-9]{1,3}(,[0-9]{0,3})*$") if commas else text.rlike(r"^[0-9]+$")
    digits = F.replace(text, F.lit(","), F.lit(""))
    bound = F.lit(True)
    if most is not None:
        width = len(str(most))
        bound = (F.length(digits) < width) | ((F.length(digits) == width) & (digits.try_cast("bigint") <= most))
    return (text == "") | (shape & bound)


#: Values a challenge rating can have (fixed values).
RATINGS = ["0", "1/8", "1/4", "1/2", *map(str, range(1, 31))]


def rating_prefix(text: Column) -> Column:
    return F.exists(F.array(*[F.lit(v) for v in RATINGS]), lambda v: v.startswith(text))


@dataclass(frozen=True)
class Field:
    name: str
    label: str
    valid: re.Pattern | None
    most: int | None = None


# The labels of the stat-block fields whose values are guarded, and the longest value.
FIELDS = [
    Field("rating", r"(?:Challenge Rating|CR)\s*:?\s*", None),
    Field("xp", r"\bXP\s*:?\s*", re.compile(r"\d{1,3}(,\d{0,3})*")),
    Field("armor", r"(?:Armor Class|AC)\s*:?\s*", re.compile(r"\d+"), 30),
    Field("hit_points", r"(?:Hit Points|HP)\s*:?\s*", re.compile(r"\d+"), 999),
]
LONGEST_VALUE = 12
_labels = [(f, re.compile(f.label, re.I)) for f in FIELDS]


def _can_start(field: Field, value: str) -> bool:
    if value == "":
        return True
    if field.valid is None:
        return any(v.startswith(value) for v in RATINGS)
    if not field.valid.fullmatch(value):
        return False
    digits = value.replace(",", "")
    return field.most is None or len(digits) < len(str(field.most)) or (len(digits) == len(str(field.most)) and int(digits) <= field.most)


@F.pandas_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
def active_field(texts: pd.Series) -> pd.DataFrame:
    """The field whose label came last, if its value is still being written; nulls otherwise."""
    names, values = [], []
    for text in texts:
        ends = [(m.end(), f) for f, label in _labels for m in label.finditer(text or "")]
        end, field = max(ends, key=lambda x: x[0], default=(0, None))
        value = (text or "")[end:]
        open_ = field is not None and len(value) <= LONGEST_VALUE and _can_start(field, value)
        names.append(field.name if open_ else None)
        values.append(value if open_ else None)
    return pd.DataFrame({"name": names, "value": values})


def repetition_penalty(logits: Column, seen: Column, penalty: float) -> Column:
    """Logits with those of tokens already seen made less likely."""
    return F.transform(logits, lambda x, i: F.when(F.array_contains(seen, i), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x))


def _bound(value: Column, use) -> Column:
    """use(value), with the value worked out once instead of once in every place and for every element."""
    return F.transform(F.array(value), use)[0]


def softmax(logits: Column) -> Column:
    raised = _bound(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return _bound(raised, lambda r: _bound(F.aggregate(r, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(r, lambda x: x / total)))


def entropy_temperature(logits: Column, low: float = 0.5, high: float = 1.3) -> Column:
    """A temperature near `high` for a sure distribution and near `low` for an unsure one."""
    entropy = -F.aggregate(softmax(logits), F.lit(0.0), lambda a, p: a + p * F.log(p + F.lit(1e-12)))
    share = F.least(F.greatest(entropy / F.log(F.size(logits).cast("double")), F.lit(0.0)), F.lit(1.0))
    return F.when(F.size(logits) <= 1, F.lit(low)).otherwise(F.lit(low) + F.lit(high - low) * (F.lit(1.0) - share))


def keep_top_k(logits: Column, k: int) -> Column:
    """Logits under the k-th highest become minus infinity."""
    least = F.get(F.sort_array(logits, asc=False), F.least(F.lit(k), F.size(logits)) - 1)
    return _bound(least, lambda low: F.transform(logits, lambda x: F.when(x < low, F.lit(float("-inf"))).otherwise(x)))


def keep_top_p(logits: Column, p: float) -> Column:
    """Logits outside the smallest head of the sorted distribution that exceeds p become minus infinity.

    The token that crosses p stays; equal logits are taken in index order.
    """
    ranked = F.array_sort(F.transform(F.arrays_zip(logits.alias("x"), softmax(logits).alias("q")), lambda e, i: F.struct((-e["x"]).alias("neg"), i.alias("i"), e["q"].alias("q"))))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("kept"))
    kept = F.aggregate(ranked, start, lambda a, e: F.struct((a["sum"] + e["q"]).alias("sum"), F.when(a["sum"] <= p, F.concat(a["kept"], F.array(e["i"]))).otherwise(a["kept"]).alias("kept")))["kept"]
    return _bound(kept, lambda held: F.transform(logits, lambda x, i: F.when(F.array_contains(held, i), x).otherwise(F.lit(float("-inf")))))
