"""Sentences of texts in any script, by semi-Markov dynamic programming over whole spans.

Every place where a sentence might end is a candidate.  A sentence is a span between two of them, and its score weighs
how it opens, how it closes, how long it is and whether its quotations are balanced, all at once; the best sequence of
spans wins.  What opens and closes sentences is learned from the first and last words of all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot.plans.lineage import cut

#: A first or last word counts from this share of the texts on, so at most 1 / SHARE words of each kind are kept.
SHARE = 1e-5
#: What every further sentence costs.
PRIOR = 0.5
#: Characters below which a sentence is too short and above which it is too long to be likely.
SHORT, LONG = 10, 600
#: Characters from which the penalty of a long sentence grows no more.
FAR = 6000

_THAI = "฀-๿"
_KANA = "ぁ-ヿ"
_CJK = "ぁ-ヿ㐀-䶿一-鿿"
_SPACE = r"\s​﻿"
_OPENING = "\"'„“”‟«»‹›‘‚’¿¡「『（(\\["
_CLOSING = "\"'”“»’›」』）)\\]"
_MARK = r"•·▪◦‣*–—\-"

# First word of a text.
_FIRST = rf"^[{_SPACE}{_MARK}{_OPENING}]*([^{_SPACE},;:.!?…。！？、，]+)(?:[.,]\d+)*(?:[{_SPACE}]+([^{_SPACE},;:.!?…]+))?"
# Stripped from either side of a last word.
_TAIL = " \t\r\n\x0b\x0c\x85\xa0\u2028\u2029\u3000​﻿\"'”“»’›」』）)].!?…。！？"
_HEAD = '"„“”«»‘(¿¡['

_first = re.compile(_FIRST[1:]).match
_cjk = re.compile(f"[{_CJK}]").match
_kana = re.compile(f"[{_KANA}]").match
_right = re.compile(rf"[{_OPENING}]*[{_SPACE}]?").match
_END = rf"(?P<end>[.!?…。！？]+)(?P<quote>(?:[{_CLOSING}]|[\s ]?[»›])*)(?P<gap>[{_SPACE}]*)"
_LINE = r"[\n\r\u2028\u2029\x85\x0b\x0c]"
# The same groups in each, so that a text without lines or Thai is searched for its full stops alone.
_ends = re.compile(rf"{_END}|(?P<line>(?!))|(?P<thai>(?!))").finditer
_any = re.compile(rf"{_END}|(?P<line>[^\S\n\r]*{_LINE}[{_SPACE}]*)|(?<=[{_THAI}])(?P<thai>[^\S\n\r]+)(?=\S)").finditer
_more = re.compile(f"{_LINE}|[{_THAI}]").search
_mark = re.compile(rf"[•·▪◦‣][{_SPACE}]*|[*–—-][{_SPACE}]+").match
_word = re.compile(rf"[^{_SPACE}]+").match
_quotes = re.compile("[\"„“”«»「」『』]").search
_each_quote = re.compile("[\"„“”«»「」『』]").findall
_lead = re.compile(rf"(?:[{_SPACE}]|[•·▪◦‣]|[*–—-](?=[{_SPACE}]))*").match
_breaks = re.compile("[\n\r\u2028\u2029\x85\x0b\x0c]+").split
_number = re.compile(r"\d+(?:[.,:]\d+)*\Z").match
_pairs = {'"': 1, "„": 2, "“": 2, "”": 2, "«": 4, "»": 4, "「": 8, "」": 8, "『": 16, "』": 16}


@dataclass(frozen=True)
class SentenceModel:
    """Words that open and close texts."""

    first: frozenset[str] = field(default_factory=frozenset)
    last: frozenset[str] = field(default_factory=frozenset)


def opener(text: str, at: int) -> str:
    """What opens a sentence at ``at``: its first word, "# word" after a number, six characters of Thai."""
    m = _first(text, at, at + 200)
    if not m:
        return ""
    one = m[1]
    if "฀" <= one[0] <= "๿":
        return one[:6]
    return f"# {m[2] or ''}" if one.isdecimal() else one


def closer(text: str) -> str:
    part = text[-80:].rstrip(_TAIL)
    word = part.split()[-1].lstrip(_HEAD) if part else ""
    return word[-5:] if "฀" <= word[-1:] <= "๿" else word


def tally(texts: Iterable[str | None], held: Counter) -> None:
    """Count the non-blank texts, what opens them and what closes them."""
    for t in texts:
        if t and not t.isspace():
            held[0, ""] += 1
            held[1, opener(t, 0)] += 1
            held[2, closer(t)] += 1


def frequent(counted: DataFrame) -> SentenceModel:
    """Model of counts (``kind, word, n``); they may be spread over several rows no more."""
    total = counted.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    kept = counted.where((F.col("kind") > 0) & (F.col("n") >= max(2.0, total * SHARE)) & (F.length("word") > 0)).select("kind", "word").collect()
    return SentenceModel(frozenset(r.word for r in kept if r.kind == 1), frozenset(r.word for r in kept if r.kind == 2))


def learn(df: DataFrame, text: str) -> SentenceModel:
    """The words that open or close at least ``SHARE`` of the non-blank texts, and at least two of them.

    All texts are counted, each worker combining its own.  Only frequent words come to the driver: as their counts add
    up to the number of texts, there are at most 1 / SHARE of each kind.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            tally(batch["t"], held)
            if len(held) > 200_000:
                yield frame(held)
                held = Counter()
        yield frame(held)

    def frame(held: Counter) -> pd.DataFrame:
        return pd.DataFrame([(kind, word, n) for (kind, word), n in held.items()], columns=["kind", "word", "n"])

    parts = df.select(F.col(text).cast("string").alias("t")).where("t is not null").mapInPandas(count, "kind int, word string, n long")
    return frequent(cut(parts.groupBy("kind", "word").agg(F.sum("n").alias("n"))))


def _opening(text: str, at: int, model: SentenceModel) -> float | None:
    """Evidence that a sentence opens here; None if none can."""
    c = text[at]
    core = at if c.isalnum() else _right(text, at).end()
    if core >= len(text):
        return None
    c = text[core]
    quoted = core > at and text[at] not in ")]）"
    known = opener(text, at) in model.first
    if known:
        return 3.0 + quoted
    if c.islower():
        return None
    if c.isdecimal():
        return -1.0
    if "฀" <= c <= "๿":
        return -3.0
    if c.isupper() or c.istitle() or c.isalpha():
        return 1.0 + quoted
    return None


def _closing(text: str, at: int, end: str, model: SentenceModel) -> float:
    """Evidence that the sentence whose final marks ``end`` begin at ``at`` closes there."""
    if not end.strip("."):
        if len(end) >= 3:
            return 1.5
        word = _word_before(text, at).lstrip(_HEAD)
        if word[-1:] in (")", "]"):
            return 2.0
        if _number(word):
            return -1.0
        short = len(word) <= 4 or "." in word
        unknown = -4.0 if short else -1.5 if len(word) == 5 else 1.0
        if "฀" <= word[-1:] <= "๿":
            return 1.0 if word[-5:] in model.last and not short else -4.0
        if word in model.last:
            return 1.5 if short else 3.0
        return unknown
    return 1.5 if end.strip(".…") == "" else 4.0


def _word_before(text: str, at: int) -> str:
    part = text[max(0, at - 60) : at]
    return part.rsplit(None, 1)[-1] if part and not part[-1].isspace() else ""


def split(text: str, model: SentenceModel) -> list[tuple[int, int]]:
    """Start and end of each sentence, in code points; white space and list marks lie outside."""
    n = len(text)
    begin = _lead(text).end()
    stop = n
    while stop > begin and (text[stop - 1].isspace() or text[stop - 1] in "​﻿"):
        stop -= 1
    if begin >= stop:
        return []
    # Candidates: where the last sentence ends, where the next begins, and the evidence of both.
    cuts: list[tuple[int, int, float]] = []
    width = 0
    for m in (_any if _more(text) else _ends)(text, begin, stop):
        at = m.end()
        if at >= stop:
            break
        end, quote, gap, line, _ = m.groups()
        marked = _mark(text, at) if line or (gap and "\n" in gap) else None
        if marked and marked.end() < stop:
            cuts.append((m.start() if line else m.end("quote"), marked.end(), 8.0))
            continue
        if end:
            nxt = text[at]
            if not gap:
                # No white space: within numbers, addresses and abbreviations unless a sentence plainly opens.
                if nxt.isdecimal() and text[m.start() - 1 : m.start()].isdecimal() and not quote:
                    continue
                if quote and quote[-1] in "」』" and _kana(nxt):
                    continue
            opened = _opening(text, at, model)
            if opened is None:
                continue
            closed = _closing(text, m.start(), end, model)
            if not gap and not _cjk(nxt) and closed < 4:
                closed -= 1.0 if nxt.isupper() else 2.0
            cuts.append((m.end("quote"), at, opened + closed))
        elif line:
            opened = _opening(text, at, model)
            if "\n\n" in line.replace("\r", "").replace(" ", ""):
                cuts.append((m.start(), at, 4.0 if opened is not None else 1.0))
                continue
            if opened is None or opened < 3:
                continue
            if not width:
                width = max(map(len, _breaks(text)))
            left = _word_before(text, m.start())
            ends = left[-5:] in model.last if "฀" <= left[-1:] <= "๿" else left.strip('"”“»’)') in model.last
            low = max(text.rfind("\n", 0, m.start()), text.rfind("\r", 0, m.start())) + 1
            nextword = _word(text, at)
            fits = m.start() - low + 1 + len(nextword[0]) <= width
            cuts.append((m.start(), at, (2.5 if ends else -2.0) + (1.5 if fits else -1.0)))
        else:
            opened = _opening(text, at, model)
            if opened is not None and opened >= 3:
                left = _word_before(text, m.start())
                cuts.append((m.start(), at, 3.0 if left[-5:] in model.last else -3.0))
    if stop - begin <= LONG:
        # Leaving out a cut that doesn't pay for itself never costs length or balance, unless the span becomes long.
        cuts = [c for c in cuts if c[2] > PRIOR]
    if not cuts:
        return [(begin, stop)]
    # Quotations: parity of each kind of mark up to every candidate.
    edges = [(begin, begin, 0.0), *cuts, (stop, stop, 0.0)]
    parity = None
    if _quotes(text):
        parity, state, at = [0], 0, begin
        for _, start, _ in edges[1:]:
            for c in _each_quote(text, at, start):
                state ^= _pairs[c]
            parity.append(state)
            at = start
    elif stop - begin <= LONG and all(b[0] - a[1] >= SHORT for a, b in zip(edges, edges[1:])):
        # Every cut pays for itself, and neither length nor balance says otherwise.
        return [(a[1], b[0]) for a, b in zip(edges, edges[1:])]
    best = [0.0] + [float("-inf")] * (len(edges) - 1)
    back = [0] * len(edges)
    # Starts too far back for any span but one of the greatest length penalty: only the best of each parity can win.
    far: dict[int, tuple[float, int]] = {}
    low = 0
    for j in range(1, len(edges)):
        end, _, evidence = edges[j]
        while low < j and end - edges[low][1] >= FAR:
            state = parity[low] if parity else 0
            if state not in far or best[low] >= far[state][0]:
                far[state] = best[low], low
            low += 1
        near = [(i, best[i]) for i in range(j - 1, low - 1, -1)]
        for i, before in [*near, *((i, v) for v, i in sorted(far.values(), key=lambda x: -x[1]))]:
            start = edges[i][1]
            size = end - start
            if size <= 0:
                continue
            score = before + evidence - PRIOR
            if size < SHORT and not _cjk(text, start):
                score -= 2.5
            elif size > LONG:
                score -= min(3.0, size / 2000)
            if parity and parity[i] != parity[j]:
                score -= 5.0
            if score > best[j]:
                best[j], back[j] = score, i
    spans, j = [], len(edges) - 1
    while j > 0:
        i = back[j]
        spans.append((edges[i][1], edges[j][0]))
        j = i
    return spans[::-1]


def sentences(df: DataFrame, keys: list[str], text: str, model: SentenceModel) -> DataFrame:
    """``keys`` with ``spans``, an array of ``start_at`` and ``end_at`` of each sentence of ``text`` in code points.

    A null or blank text has no sentences.  Very long texts are split as a whole.  Repeated rows stay repeated; columns
    other than the keys are dropped.  An empty table gives an empty table.  The model is broadcast; its size is bounded
    by ``SHARE``.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<start_at:int,end_at:int>>")
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([[] if t is None else [{"start_at": a, "end_at": b} for a, b in split(t, shared.value)] for t in part])

    return df.select(*keys, F.col(text).cast("string").alias("_text")).select(*keys, spans("_text").alias("spans"))
