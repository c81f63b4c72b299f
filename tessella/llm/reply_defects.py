"""Defective replies: labelling functions for each defect, joined by an expectation-maximization label model.

Every labelling function looks at one thing, is wrong at times and votes yes, no or abstains; none of them makes the
verdict of its defect.  For each defect the votes of a record make a pattern; the model sees only the counts of the
patterns over all records, estimates how common the defect is and how each function votes on defective and on sound
records, and gives the posterior of the defect for each pattern.  A record keeps every defect whose posterior exceeds
that defect's cutoff (`labels`), or its most probable one (`defects`).  The cutoffs are checked on further
hand-labelled pairs in the tests.

A null reply is empty.  A null question leaves only `empty`, `refusal` and `truncated` to be told.  Repeated ids give
one row.  Texts are read whole.  Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.language import ALL_FUNCTION_WORDS, detect, language_scores, letters_words
from tessella.runtime import materialize

DEFECTS = ("empty", "copied", "refusal", "language", "truncated")
NONE, YES, NO = 0, 1, 2

_TAG = re.compile(r"<[^<>]{0,40}>")
_UNSEEN = re.compile("[­​-‏⁠﻿]")
_WORDS = re.compile(r"[^\W_]+")
_PLACEHOLDER = re.compile(
    r"(n ?a|null|none|nil|nan|undefined|tbd|tba|tbc|todo|to ?do|blank|empty|deleted|removed|redacted|placeholder|pending|missing|unknown|stub|void|x{2,}|"
    r"no (answer|reply|response|content|text|data|comment)s?( (yet|given|available|provided|found))?|not (available|applicable|answered)|(answer|text|content|reply|response|comment|post|message)( (here|was))? (deleted|removed|missing|pending|goes here|to follow|unavailable)|"
    r"(insert|add|your) (answer|text|reply|response)( here)?|coming soon|lorem ipsum|sin respuesta|pendiente|vacío|sans réponse|aucune réponse|vide|keine antwort|leer|entfällt|gelöscht|eliminado|supprimé)"
)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”’')\]*_]*\s+|\n+")
_FIRST_PERSON = re.compile(r"\b(i|i'm|i'd|i've|me|my|we|our|us)\b|\b(yo|puedo|debo|lo siento|me|mis?|prefiero)\b|\b(je|j'|mes?|mon|moi|désolée?)\b|\b(ich|mir|mich|meine?|leider)\b")
_DECLINE = re.compile(
    r"\b(i|we)( am|'m| are|'re)?( really| simply| just| also)? ?(can'?t|cannot|can not|could not|couldn'?t|won'?t|will not|unable to|not able to|not allowed to|not permitted to|not going to|do(n't| not) feel comfortable|do(n't| not) want to|must decline|have to decline|must refuse|refuse to|have to pass|decline to)"
    r"( [a-z']+){0,2}? ?(help|assist|answer|provide|discuss|talk|respond|comment|comply|giv|share|speak|advise|offer|engage|support|do that|this|with|on this|to answer|$)"
    r"|\b(i|we)( must| have to| need to| will)? (decline|pass on th|refuse)"
    r"|\b(i|we)('d| would) rather not|\bguidelines (do not|don'?t|won'?t|prevent|forbid)|\boutside what i am allowed|\bnot be appropriate for me|\bnot (allowed|permitted|something i can)\b.{0,40}\b(answer|respond|discuss|help)"
    r"|\bno (response|answer|information|help|comment|advice|details?) (can|could|will|may) be (given|provided|offered|shared|made)|\b(this|that|the) (question|request|topic) (can'?t|cannot|can not|will not|won'?t) be (answered|discussed|processed|fulfilled)"
    r"|\b(unable|not able) to (assist|help|answer|respond|comment|provide|discuss)"
    r"|\bno (puedo|me es posible|estoy en condiciones)\b.{0,40}\b(ayudar|responder|contestar|hablar|comentar|opinar|eso|esto)|\bprefiero no\b|\bdebo declinar\b|\bmis (directrices|normas)\b"
    r"|\bje ne (peux|puis) pas\b.{0,40}\b(aider|répondre|parler|commenter|cela|discuter)|\bje préfère ne pas\b|\bje dois (décliner|refuser)\b|\bmes (directives|consignes)\b"
    r"|\b(ich )?kann (ich |dir |ihnen |euch |dabei |dazu |darauf |das |diese frage ){0,3}(leider )?(nicht|keine)\b.{0,40}\b(helfen|beantworten|antworten|sagen|auskunft)|\bmöchte ich (lieber )?nicht\b|\bmuss (ich )?ablehnen\b|\bmeine (richtlinien|vorgaben)\b"
)
#: Every way to decline holds one of these.
_TRIGGER = re.compile(r"can'?t|something i can|have to pass|cannot|can not|could|won'?t|will|unable|able to|allowed|permitted|going to|comfortable|want to|declin|refuse|pass on|rather not|guidelines|appropriate|no (?:response|answer|information|help|comment|advice|detail)|puedo|posible|condiciones|prefiero|directrices|normas|peux|puis|préfère|dois|directives|consignes|kann|möchte|muss|richtlinien|vorgaben")
_HEDGE = re.compile(r"\b(stress|emphasi[sz]e|recommend|quote|go into|allow it|do that twice|thank|wait|imagine|believe|think of)\b")
_COURTESY = re.compile(
    r"^(sorry|apologies|unfortunately|i'?m sorry|i apologi[sz]e|i understand( the question)?|as an? (ai|assistant|language model)[a-z ]*|please|try|ask|talk to|see|consult|contact|perhaps|maybe|you (may|might|could|should)|is there|that is (a|my)|thank|thanks|good luck|"
    r"lo siento|por favor|quizás|désolée?|malheureusement|peut-être|veuillez|leider|bitte|vielleicht|tut mir leid|es tut mir leid)\b"
)
_SIGN_OFF = re.compile(
    r"(hope (that|this|it) helps|happy [a-z]+|cheers|best|regards|best regards|kind regards|thanks|thank you|good luck|have fun|enjoy|yours|sincerely|"
    r"saludos|un saludo|suerte|gracias|cordialement|bonne chance|merci|salut|viel spa(ß|ss)|viele grüße|grüße|gruß|danke|viel glück)([ ,]+[\w'’.-]+){0,3}",
    re.I,
)
_CLOSED = re.compile(r"(\((see|cf\.?|p\.|pp\.|ref|source|siehe|vgl|véase|ver|voir)[^()]*\)|\[[^\[\]()]{1,40}\](\([^()\s]+\))?|[=≈]\s*[-+]?[\d.,]+[)\]]?|```|</[A-Za-z][\w:.-]*>|https?://[^\s()]+|[:;=]-?[)DPp(]|[™®©%°$€£]|[\U0001F300-\U0001FAFF☀-➿]️?|\*\*?[^*\n]+[.!?]\*\*?)$")
_FULL_STOP = re.compile(r"[.!?。！？][\"”“’'»«)\]}*_`]*$")
_DANGLING = re.compile(r"([,;:\-–—+/*=&(\[{<“«„]|…|\.\.\.?\.?|\[(\.\.\.|…)\]|\]\([^)]*|\(\s*(p|see|cf|z\.B|e\.g|i\.e)\.?)$", re.I)
_TRAILS = re.compile(r"(…|\.\.)[\]\"”’')]*$")
_ENDED = re.compile(r"[.!?。！？][\"”“’'»«)\]}*_`]*\s")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)]|[a-z][.)]|\[[ x]\])(?:\s+(.*))?$", re.I)


def visible(text: str | None) -> str:
    """The text without markup, entities and invisible characters."""
    if text is None:
        return ""
    return _UNSEEN.sub("", _TAG.sub(" ", html.unescape(text))).replace(" ", " ").strip()


def empty_votes(reply: str | None, seen: str, words: list[str]) -> tuple[int, ...]:
    """No words; nothing but a placeholder; signs only; marked up or in brackets as a whole; a word or two; a number."""
    bare = " ".join(words) if len(words) <= 8 else "-"
    framed = bool(re.fullmatch(r"[\[(<{].*[\])>}]", (reply or "").strip(), re.S)) if len(words) <= 8 else False
    return (
        NO if words else YES,
        NONE if not words else YES if _PLACEHOLDER.fullmatch(bare) else NO,
        YES if seen and not words else NONE,
        YES if framed else NONE,
        NO if len(words) >= 4 else NONE,
        NO if any(w.isdigit() for w in words[:8]) or seen.endswith("!") else NONE,
    )


def _close(a: str, b: str) -> bool:
    """Equal up to one edit or one swap of neighbours, for words of four letters or more."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def _edit_keys(word: str) -> list[str | tuple[int, str, bool]]:
    """Keys of which two words that are `_close` have one in common: the word less a letter or, if long, its halves."""
    n = len(word)
    keys: list[str | tuple[int, str, bool]] = []
    if n <= 41:
        keys += [word, *(word[:i] + word[i + 1 :] for i in range(n))]
    if n >= 41:  # one edit or swap leaves a half of the shorter word as it is
        for h in ((n - 2) // 2, (n - 1) // 2):
            keys += [(h, word[:h], False), (h, word[-h:], True)]
    return keys


def _matched(left: Counter, extra: list[str]) -> tuple[int, list[str]]:
    """Number of `extra` words that are misspelt ones of `left`, each taken once and the first one first; the others."""
    words = [w for w, c in left.items() if c > 0]
    rest = {w: left[w] for w in words}
    at: dict[object, list[int]] = {}
    for i, w in enumerate(words):
        for key in set(_edit_keys(w)):
            at.setdefault(key, []).append(i)
    sizes = {len(w) + d for w in words for d in (-1, 0, 1)}
    met, over = 0, []
    for w in extra:
        near = {i for key in _edit_keys(w) for i in at.get(key, ())} if len(w) in sizes and met < left.total() else ()
        twin = next((i for i in sorted(near) if rest[words[i]] and _close(w, words[i])), None)
        if twin is None:
            over.append(w)
        else:
            rest[words[twin]] -= 1
            met += 1
    return met, over


def overlap(question: list[str], reply: list[str]) -> tuple[float, int]:
    """Share of the question's words met in the reply, and the number of reply words that aren't the question's."""
    have = Counter(question)
    met, extra = 0, []
    for w in reply:
        if have.get(w, 0) > 0:
            have[w] -= 1
            met += 1
        else:
            extra.append(w)
    own = sum(w not in have for w in extra)
    # misspellings alone can't make up for few words met; a reply of mostly its own words is no copy, whatever is misspelt
    if met < 0.35 * len(question) or own - have.total() > _most_own(question):
        return met / max(1, len(question)), own
    more, over = _matched(have, extra)
    return (met + more) / max(1, len(question)), sum(w not in have for w in over)


def _most_own(question: list[str]) -> int:
    """Most words of its own that a reply may have besides the question's to be judged as a copy at all."""
    return 3 * len(question) + 12


def copied_votes(question: str | None, seen: str, q: list[str], r: list[str]) -> tuple[int, ...]:
    """Most words of the question are met; hardly any others are; it ends by asking; the order is the question's; no sentence says more."""
    if not q or not r:
        return (NONE, NO if r else NONE, NONE, NONE, NO if r else NONE)
    share, extra = overlap(q, r)
    asked = set(q)
    stop = seen[-80:].rstrip(" \"”’'*_>)]\n")
    asks = YES if stop.endswith("?") else NO if stop.endswith((".", "!")) else NONE
    if share < 0.5:  # too little is met for order and sentences to tell anything
        return (NO, YES if extra <= max(3, 0.25 * len(q)) else NO, asks, NO, NO if len(r) >= 4 else YES)
    neighbours = set(zip(q, q[1:])) or {(q[0], q[0])}
    kept = len(neighbours & set(zip(r, r[1:]))) / len(neighbours)
    more = sum(len(_WORDS.findall(s)) >= 4 and not _restates(s, asked) for s in _SENTENCE.split(seen.lower()) if s)
    return (
        YES if share >= 0.7 else NO,
        YES if extra <= max(3, 0.25 * len(q)) else NO,
        asks,
        YES if kept >= 0.5 else NO if kept < 0.2 else NONE,
        NO if more else YES,
    )


def _restates(sentence: str, asked: set[str]) -> bool:
    """Whether at least four in five words of the sentence are the question's."""
    words = _WORDS.findall(sentence)
    return 5 * sum(w in asked for w in words) >= 4 * len(words)


def refusal_votes(seen: str, r: list[str], q: list[str] | tuple[str, ...] = ()) -> tuple[int, ...]:
    """A way to decline; a hedge in it; no sentence that answers; words of courtesy or rules; many words; first person.

    Sentences that give the question back answer nothing and don't count as the reply's words.
    """
    if not r:
        return (NONE,) * 6
    text = seen.replace("’", "'").lower()
    if not _TRIGGER.search(text):  # no way to decline; then the rest is told by length alone
        return (NO, NONE, NO if len(r) >= 4 else YES, NONE, NO if len(r) > 45 else NONE, NONE)
    sentences = [s for s in _SENTENCE.split(text.strip()) if s and _WORDS.search(s)]
    declines = [bool(_TRIGGER.search(s) and _DECLINE.search(s)) for s in sentences]
    hedged = [d and bool(_HEDGE.search(s)) for s, d in zip(sentences, declines)]
    asked = set(q)
    own = [(s, d and not h, len(_WORDS.findall(s))) for s, d, h in zip(sentences, declines, hedged) if d or not asked or not _restates(s, asked)]
    courteous = [bool(_COURTESY.match(s.strip(" \"'“*_>-"))) for s, _, _ in own]
    answers = any(not d and not c and n >= 4 for (_, d, n), c in zip(own, courteous))
    return (
        YES if any(declines) else NO,
        NO if any(hedged) else NONE,
        NO if answers else YES,
        YES if any(courteous) or "guidelines" in text else NONE,
        NO if sum(n for *_, n in own) > 45 else NONE,
        YES if _FIRST_PERSON.search(text) else NO,
    )


def language_votes(asked: str, seen: str) -> tuple[int, ...]:
    """Another language has more function words; no sentence is in the question's language; its function words are few; letters with marks differ."""
    qw, rw = letters_words(asked), letters_words(seen)
    if not qw or len(rw) < 5:
        return (NONE,) * 4
    lq = detect(qw, least=0.9, margin=1.3)
    got = language_scores(rw)
    most = max(got.values(), default=0.0)
    plain = lambda ws: sum(not w.isascii() for w in ws) / max(1, len(ws))
    other = NONE if lq is None or most < 1.4 else YES if got.get(lq, 0.0) < most else NO
    # where the question's language leads, some sentence is in it
    told = [lq] if other == NO else [] if lq is None else [detect(letters_words(s), least=1.0, margin=1.3) for s in _SENTENCE.split(seen) if s]
    return (
        other,
        NONE if lq is None or not any(told) else NO if lq in told else YES,
        NONE if lq is None or most < 1.4 else YES if got.get(lq, 0.0) <= 0.3 * most else NO,
        YES if other != NO and abs(plain(qw) - plain(rw)) > 0.05 else NONE,
    )


def _unclosed(text: str) -> bool:
    """Whether a fence, a tool tag or a bracket of the last paragraph stays open."""
    if text.count("```") % 2:
        return True
    if len(re.findall(r"<TOOL(?::[^<>]*)?>", text, re.I)) > len(re.findall(r"</TOOL>", text, re.I)):
        return True
    last = text[text.rfind("\n\n") + 1 :]
    if last.rfind("(") > last.rfind(")"):
        return True
    return last.rfind("[") > last.rfind("]") and not re.search(r"\[[ x]\]", last[last.rfind("[") :] + "]")


def truncated_votes(reply: str | None, r: list[str]) -> tuple[int, ...]:
    """No end mark; a dangling sign; something left open; a function word at the end; the last item of a list; a sign-off; a closing reference, formula or sign; few words; no end mark though an earlier line or sentence has one."""
    text = (reply or "").rstrip()
    if not r:
        return (NONE,) * 9
    lines = [x for x in text.split("\n") if x.strip()]
    last = lines[-1].strip()
    stop = bool(_FULL_STOP.search(last[-60:]))
    item = _ITEM.match(lines[-1])
    before = _ITEM.match(lines[-2]) if len(lines) > 1 else None
    bare = item is not None and not (item.group(1) or "").strip(" .")
    words = letters_words(last)
    hanging = bool(words) and words[-1] in ALL_FUNCTION_WORDS and last[-1].isalpha()
    listed = item is not None and not bare and not hanging and (before is None or not before.group(1) or _FULL_STOP.search(before.group(1).strip()) is None)
    tail = re.split(r"(?<=[.!?”\"’')\]>`])\s+", last)[-1].strip(" .!*_")
    signed = bool(_SIGN_OFF.fullmatch(tail)) or bool(re.search(r"[.!?][\"”’')\]]*\s+[-–—]\s?\w+$", last))
    return (
        NO if stop else YES,
        YES if _DANGLING.search(last) or bare else NONE,
        YES if _unclosed(text) else NONE,
        YES if hanging else NONE,
        NO if listed else NONE,
        NO if signed else NONE,
        NO if _CLOSED.search(last) and not _TRAILS.search(last) else NONE,
        NO if len(r) < 4 else NONE,
        NONE if item is not None or _TRAILS.search(last) else NO if stop else YES if _ENDED.search(text) else NONE,
    )


def votes(question: str | None, reply: str | None) -> tuple[tuple[int, ...], ...]:
    """The votes for each of DEFECTS."""
    seen, asked = visible(reply), visible(question)
    q, r = _WORDS.findall(asked.lower()), _WORDS.findall(seen.lower())
    return (empty_votes(reply, seen, r), copied_votes(question, seen, q, r), refusal_votes(seen, r, q), language_votes(asked, seen), truncated_votes(reply, r))


WIDTHS = tuple(len(v) for v in votes("a", "b"))


def _code(v: tuple[int, ...]) -> int:
    n = 0
    for x in v:
        n = 3 * n + x
    return n


def _voter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [[_code(v) for v in votes(q, r)] for q, r in zip(batch.column("question").to_pylist(), batch.column("reply").to_pylist())]
        cols = list(zip(*codes)) if codes else [[]] * len(DEFECTS)
        yield pa.record_batch([batch.column("tbl"), batch.column("id"), *(pa.array(c, pa.int32()) for c in cols)], names=["tbl", "id", *DEFECTS])


#: Chances, before any record is seen, that a function of the defect says (yes of a sound, no of a sound, yes of a
#: defective, no of a defective record); it abstains otherwise.  In the order of the votes.
BELIEFS = {
    "empty": ((0.002, 0.996, 0.7, 0.298), (0.004, 0.99, 0.3, 0.01), (0.002, 0.001, 0.3, 0.001), (0.01, 0.001, 0.15, 0.001), (0.001, 0.85, 0.001, 0.01), (0.001, 0.2, 0.001, 0.02)),
    "copied": ((0.03, 0.95, 0.95, 0.04), (0.1, 0.88, 0.95, 0.04), (0.05, 0.75, 0.5, 0.1), (0.02, 0.9, 0.85, 0.05), (0.1, 0.88, 0.95, 0.04)),
    "refusal": ((0.01, 0.97, 0.96, 0.03), (0.001, 0.02, 0.0005, 0.0005), (0.08, 0.9, 0.98, 0.01), (0.03, 0.001, 0.5, 0.001), (0.001, 0.5, 0.001, 0.02), (0.3, 0.7, 0.8, 0.2)),
    "language": ((0.03, 0.9, 0.95, 0.03), (0.02, 0.9, 0.9, 0.0005), (0.02, 0.9, 0.85, 0.1), (0.05, 0.001, 0.5, 0.001)),
    "truncated": (
        (0.12, 0.87, 0.8, 0.19), (0.0003, 0.001, 0.4, 0.001), (0.002, 0.001, 0.15, 0.001), (0.001, 0.001, 0.2, 0.001), (0.001, 0.1, 0.001, 0.0005),
        (0.001, 0.05, 0.001, 0.0005), (0.001, 0.1, 0.001, 0.0005), (0.001, 0.1, 0.001, 0.0005), (0.05, 0.86, 0.75, 0.12),
    ),
}
#: Of a function of which nothing is known but that it is better than chance.
ANY = (0.05, 0.85, 0.8, 0.1)


@dataclass
class LabelModel:
    """Two-class model of one defect: its prior, and P(vote | class) of each labelling function, to abstain included.

    The rates are the geometric mean of belief and count, the counts at weight `learn`; the prior is counted freely.
    """

    width: int
    beliefs: tuple[tuple[float, float, float, float], ...] | None = None
    learn: float = 0.3
    prior: float = 0.02
    rates: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, counts: dict[int, int], rounds: int = 60) -> LabelModel:
        stated = self.beliefs or (ANY,) * self.width
        belief = np.array([[[1 - x[2 * c] - x[2 * c + 1], x[2 * c], x[2 * c + 1]] for x in stated] for c in (0, 1)])
        belief = np.maximum(belief, 0.0002)
        belief /= belief.sum(axis=2, keepdims=True)
        self.rates = belief.copy()
        patterns = np.array([_votes_of(c, self.width) for c in counts], dtype=int).reshape(-1, self.width)
        n = np.array(list(counts.values()), dtype=float)
        for _ in range(rounds if len(n) else 0):
            post = self._posterior(patterns)
            self.prior = float((n @ post + 1) / (n.sum() + 50))
            for c, w in ((0, n * (1 - post)), (1, n * post)):
                for j in range(self.width):
                    got = np.bincount(patterns[:, j], weights=w, minlength=3)
                    rate = belief[c, j] ** (1 - self.learn) * np.maximum(got / max(got.sum(), 1e-9), 1e-5) ** self.learn
                    self.rates[c, j] = rate / rate.sum()
        return self

    def _posterior(self, patterns: np.ndarray) -> np.ndarray:
        logs = [np.log(self.rates[c])[np.arange(self.width), patterns].sum(axis=1) for c in (0, 1)]
        odds = np.log(self.prior / (1 - self.prior)) + logs[1] - logs[0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def posteriors(self, codes: Iterable[int] | None = None) -> dict[int, float]:
        """The posterior of each pattern of votes; of all patterns that there can be, if none are given."""
        codes = list(range(3**self.width)) if codes is None else list(codes)
        patterns = np.array([_votes_of(c, self.width) for c in codes], dtype=int).reshape(-1, self.width)
        return dict(zip(codes, self._posterior(patterns).tolist()))


def _votes_of(code: int, width: int) -> list[int]:
    return [code // 3 ** (width - 1 - j) % 3 for j in range(width)]


#: Least posterior at which a label is kept: inside the gap between defective and sound hand-labelled pairs.
CUTOFFS = {"empty": 0.5, "copied": 0.7, "refusal": 0.4, "language": 0.5, "truncated": 0.45}


def labels(pairs: DataFrame, cutoffs: dict[str, float] = CUTOFFS) -> DataFrame:
    """(tbl, id, defect, posterior): all defects over their cutoffs.  Needs pairs(tbl, id, question, reply)."""
    voted = pairs.filter(F.col("id").isNotNull()).select("tbl", F.col("id").cast("long").alias("id"), "question", "reply")
    voted = materialize(voted.mapInArrow(_voter, "tbl string, id long, " + ", ".join(f"{d} int" for d in DEFECTS)), "votes")
    long = voted.select("tbl", "id", F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("code")) for d in DEFECTS])).alias("v")).select("tbl", "id", "v.*")
    counts: dict[str, dict[int, int]] = {d: {} for d in DEFECTS}
    for row in long.groupBy("defect", "code").count().collect():  # at most the sum of 3 ** WIDTHS rows
        counts[row["defect"]][row["code"]] = row["count"]
    kept = []
    for d, width in zip(DEFECTS, WIDTHS):
        model = LabelModel(width, BELIEFS[d]).fit(counts[d])
        kept += [(d, code, p) for code, p in model.posteriors(counts[d]).items() if p >= cutoffs[d]]
    spark = pairs.sparkSession
    table = spark.createDataFrame(kept, "defect string, code int, posterior double") if kept else spark.createDataFrame([], "defect string, code int, posterior double")
    return long.join(F.broadcast(table), ["defect", "code"]).groupBy("tbl", "id", "defect").agg(F.max("posterior").alias("posterior"))  # table: at most a row for each pattern of votes


def defects(pairs: DataFrame, cutoffs: dict[str, float] = CUTOFFS) -> DataFrame:
    """(tbl, id, defect): the most probable defect of each defective record; ties go to the earlier one of DEFECTS."""
    place = F.create_map(*[x for i, d in enumerate(DEFECTS) for x in (F.lit(d), F.lit(-i))])
    best = labels(pairs, cutoffs).groupBy("tbl", "id").agg(F.max_by("defect", F.struct(F.round("posterior", 3), place[F.col("defect")])).alias("defect"))
    return best
