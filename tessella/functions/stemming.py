"""Porter stems of words, with the common extensions (irregular forms, short words left alone).

The rules are stated as tables of suffixes; a stemmer is a fold over them.  Words are stemmed once per worker.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = frozenset("aeiou")
# Forms that no rule gives.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning",
    "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# Suffixes of the second, third and fourth step, in the order in which they are tried.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """The word as consonants and vowels; y is a vowel after a consonant."""
    out: list[str] = []
    for i, ch in enumerate(word):
        vowel = ch in VOWELS or (ch == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    shape = _shape(word)
    return (shape[-3:] == "cvc" and word[-1] not in "wxy") or (len(word) == 2 and shape == "vc")


def porter(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past and progressive forms
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")):
                word = cut + "e"
            elif _double(cut):
                word = cut[:-1] if cut[-1] not in "lsz" else cut
            elif _measure(cut) == 1 and _cvc(cut):
                word = cut + "e"
            else:
                word = cut
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    # derived forms; the first suffix that fits decides, whether or not its condition holds
    word = _second(word)
    for suffix, to in STEP3:
        if word.endswith(suffix):
            if _measure(word[: -len(suffix)]) > 0:
                word = word[: -len(suffix)] + to
            break
    for suffix in STEP4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _cvc(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def _second(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _second(word[:-4] + "al")
    for suffix, to in STEP2:
        if word.endswith(suffix):
            return word[: -len(suffix)] + to if _measure(word[: -len(suffix)]) > 0 else word
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return word


# What a token is, and which tokens are acronyms.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9&\-']*"
ACRONYM = r"^[A-Z][A-Z0-9&\-]{0,5}$"
_token, _acronym = re.compile(TOKEN), re.compile(ACRONYM)
_known: dict[str, str] = {}


def stem(word: str) -> str:
    """Lower case for acronyms of up to six characters, the Porter stem for other words."""
    got = _known.get(word)
    if got is None:
        if len(_known) > 500_000:
            _known.clear()
        got = _known[word] = word.lower() if _acronym.match(word) else porter(word.lower())
    return got


def token_array(c: Column) -> Column:
    """Tokens of two characters or more, as they stand."""
    return F.filter(F.regexp_extract_all(c, F.lit(f"({TOKEN})"), F.lit(1)), lambda x: F.length(x) > 1)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(texts: pd.Series) -> pd.Series:
    """The stems of a text's tokens, in order; null for null."""
    return texts.map(lambda t: None if t is None else [stem(w) for w in _token.findall(t) if len(w) > 1])
