"""Keyword-stuffed and link-list pages, told by the shapes of their lines.

A line is reduced to a shape: grades of how many words, capitals, separated items and links it has, marks of what else its
form says, and how it ends.  What is left of a page in lines that read like sentences is reduced once more, run by run from
full stop to full stop.  Whether a shape is one of sentences, of an honest list or of stuffing is read from the shape alone;
lines are then grouped by shape, and a page is flagged if its ``FEW`` largest groups of stuffing hold more than half of its
characters.  Each page is judged by itself, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a page's characters from which stuffing makes a case, and how many shapes may hold it.
SHARE, FEW = 0.5, 16
#: Share of a run of words that comes three times or more, from which the run is repetition; and from which items are alike.
REPEATED, ALIKE = 0.5, 0.3
#: Longest token that can be a keyword; clauses of scripts without spaces are longer.
KEYWORD = 20
#: Longest line of contents that may lack its page number, and how many of them make contents.
LISTED, LISTING = 120, 3

_HIDDEN = "​‌‍⁠﻿­"
_INVISIBLE = dict.fromkeys(map(ord, _HIDDEN), None)
_hidden = re.compile(f"[{_HIDDEN}]").search
_LEET = str.maketrans("013457@$", "oieastas")

_word = re.compile(r"[\w฀-๿]+").findall
_digit = re.compile("[013457]").search
_link = re.compile(r"https?://\S+|www\.\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:example|test|com|net|org|info|biz|shop|[a-z]{2})/\S*|<a\s+href|\]\(\S+\)", re.I)
_markup = re.compile(r"</?a[^>]*>")
_price = re.compile(r"\bSKU\b|[€$£¥]\s?\d|\d\s?(?:[€$£¥]|EUR\b|USD\b)", re.I).search
_hash = re.compile(r"[#＃]\w+").findall
_counter = re.compile(r"(?:[»>/]\s*\d+|[\[(]\s*\d+\s*[\])])$").search
_CLOSING, _FINAL = "\"'“”»’›」』)] \t\u3000\xa0", ".!?…。！？:："
_stop = re.compile(r"[.!?…。！？][\"'“”»’›」』)\]]*\s+|[。！？]").finditer
_items = re.compile(r"\s*[,;|·•、，；/]\s*|\s+[-–—»>*]\s+|\s{2,}|\t").split
_tags = re.compile(r"\s*(?:tags?|keywords?|schlagw\w+|mots-clés|etiquetas)\s*[:：]", re.I).match
_lines = re.compile(r"[\r\n  \x0b\x0c\x85]+").split
# What a line needs to be more than a plain sentence if it ends like one.
_special = re.compile(r"[/#＃|\t€$£¥…\[(]|SKU|Sku|sku|EUR|Eur|eur|USD|Usd|usd|www\.|\.{3}|_{3}|·{3}").search

_thai = re.compile("[฀-๿]").search

# Honest lists by their form.
_reference = re.compile(r"\s*(?:\[?\d+[.)\]])\s+\w[\w'’-]*\s+\w{1,3}\b.*\(|.*/doi/").match
_contact = re.compile(r"\s*[^\W\d_][\w'’ .-]*,\s*[^\W\d_][\w'’ .-]*\s\d{4,6}\b").match
_term = re.compile(r"\s*[^\t]{1,40}\t\s*\S").match
_LEADERS = ("...", "…", "···", "___")


def _units(text: str) -> list[str]:
    """Runs from full stop to full stop."""
    out, at = [], 0
    for m in _stop(text):
        out.append(text[at : m.start() + 1])
        at = m.end()
    out.append(text[at:])
    return out


def links(line: str) -> int:
    return len(_link.findall(line)) if "/" in line or "www." in line or "(" in line else 0


def _ended(line: str) -> bool:
    """Whether a line ends like a sentence."""
    return line.rstrip().rstrip(_CLOSING)[-1:] in tuple(_FINAL)


def plain(text: str) -> str:
    """The text without invisible characters."""
    return text.translate(_INVISIBLE) if _hidden(text) else text


def tokens(line: str) -> list[str]:
    """Words in lower case, digits that stand for letters read as letters."""
    words = _word(line.lower())
    return [w if w.isalpha() or w.isdecimal() else w.translate(_LEET) for w in words] if _digit(line) else words


def repetition(words: list[str], least: float = ALIKE) -> float:
    """Share of the words that come three times or more among them; 0 for fewer than eight, and if below ``least``."""
    n = len(words)
    # If a share r comes three times, no more than 1 - 2r/3 of all are different.
    if n < 8 or len(set(words)) > n * (1 - 2 * least / 3):
        return 0.0
    counts = Counter(w for w in words if 1 < len(w) <= KEYWORD and not w.isdecimal())
    return sum(c for c in counts.values() if c >= 3) / n


def _leader(line: str) -> str | None:
    """What follows the leader of a line of contents: its page number or nothing; None if there is no leader."""
    bare = line.rstrip()
    head = bare.rstrip("0123456789")
    return bare[len(head) :] if head.rstrip().endswith(_LEADERS) else None


def _cells(line: str) -> bool:
    bare = line.strip()
    return len(bare) > 1 and bare[0] == "|" == bare[-1]


def _passes(line: str, form: str) -> bool:
    """Whether a line of an honest form is free of repetition, lists of links and product tags."""
    n = links(line)
    if n and (form in ("contents", "cells", "term") or n >= 2 and len(_word(_link.sub(" ", line))) < 5 * n):
        return False
    if form in ("cells", "term") and (_price(line) or _tags(line) or len(_hash(line)) >= 2):
        return False
    return repetition(tokens(line), REPEATED) < REPEATED


def honest(lines: list[str]) -> list[bool]:
    """Which lines of a page have the form of references, contents, terms, doses (table rows) or contacts.

    A form alone isn't enough: its line must pass the tests of repetition, links and tags.  Leaders without a page number
    count if several short lines have them; rows between pipes if there are two or more, and rows without any digit only
    if they aren't the same few words again and again.
    """
    leaders = [_leader(x) for x in lines]
    bare = [x for x, m in zip(lines, leaders) if m == "" and len(x) <= LISTED]
    listed = len(bare) >= LISTING and repetition([w for x in bare for w in tokens(x)], REPEATED) < REPEATED
    table = [x for x in lines if _cells(x)]
    loose = [x for x in table if not any(c.isdecimal() for c in x)]
    heads = {x.split("|")[1].strip().casefold() for x in loose}
    same = bool(loose) and 2 * len(heads) <= len(loose) and repetition([w for x in loose for w in tokens(x)], REPEATED) >= REPEATED
    out = []
    for x, leader in zip(lines, leaders):
        form = None
        if leader or leader is not None and listed and len(x) <= LISTED:
            form = "contents"
        elif _cells(x):
            form = "cells" if len(table) > 1 and not (same and not any(c.isdecimal() for c in x)) else None
        elif "," in x and _contact(x):
            form = "contact"
        elif ("/doi/" in x or x.lstrip()[:1] in "[0123456789") and _reference(x):
            form = "reference"
        elif "\t" in x and _term(x) and x.count("\t") <= 3:
            form = "term"
        out.append(form is not None and _passes(x, form))
    return out


def _grade(n: int) -> str:
    return "0" if n == 0 else "1" if n == 1 else "2" if n <= 3 else "4" if n <= 7 else "8" if n <= 12 else "m"


def shape(line: str, exempt: bool = False, alike: bool = False) -> str:
    """Shape of a line: grades of its words, capitals, items and links, marks, and "." if it ends like a sentence, else "-".

    Marks: H an ``exempt`` line of an honest list, T a label of tags, P a price or article number, # hashtags (two, or
    nothing else), C a counter at the end, K many short items that are alike or many, A a line that opens like others of its
    page (``alike``), R repetition within the line.  Words are counted without links; of a plain sentence only the first
    capital counts, and a line that ends like one is one item.
    """
    bare = line.strip()
    end = _ended(bare)
    if end and not exempt and not _special(bare) and not ((":" in bare or "：" in bare) and _tags(bare)):
        return f"w{_grade(bare.count(' ') + 1)}c{int(bare[0].isupper())}i1l0."
    n_links = links(bare)
    rest = _markup.sub(" ", _link.sub(" ", bare)) if n_links else bare
    end = end if not n_links else _ended(rest)
    words = _word(rest)
    marks, n_items = "H" if exempt else "", 1
    if not exempt:
        hashes = _hash(bare) if "#" in bare or "＃" in bare else ()
        marks += "T" if (":" in bare or "：" in bare) and _tags(bare) else ""
        marks += "P" if _price(bare) else ""
        marks += "#" if len(hashes) >= 2 or (len(hashes) == 1 and len(hashes[0]) >= 0.8 * len(bare)) else ""
        marks += "C" if bare[-1:] in "0123456789])" and _counter(bare) else ""
        if not end:
            items, own = [x for x in _items(bare) if x], tokens(bare)
            n_items, same = len(items), repetition(own)
            if n_items >= 4 and len(own) <= 5 * n_items and max(map(len, items)) <= 60 and not any(x[0].isdecimal() for x in items):
                marks += "K" if same >= ALIKE or len({x.casefold() for x in items}) < n_items or n_items >= 5 else ""
            marks += "A" if alike else ""
            marks += "R" if same >= REPEATED and len(_units(bare)) == 1 else ""
    return f"w{_grade(len(words))}c{_grade(sum(w[0].isupper() for w in words))}i{_grade(n_items)}l{_grade(n_links)}{marks}{'.' if end else '-'}"


_shape = re.compile(r"w(.)c.i.l(.)(\D*)([.-])\Z").match


def is_stuffing(form: str) -> bool:
    """Whether a shape is one of stuffing: of tags, prices, hashtags, counters, links, items or repetition, not of sentences."""
    words, n_links, marks, end = _shape(form).groups()
    if "H" in marks:
        return False
    if set(marks) & set("TP#KARD"):
        return True
    if n_links not in "01" or n_links == "1" and end == "-" and words in "01248":
        return True
    return "C" in marks and words in "01248"


def _alike(lines: list[str], forms: list[str]) -> set[int]:
    """Lines that open with the same two words as three others and don't end like sentences: a keyword with ever other names."""
    heads: dict[tuple[str, ...], list[int]] = {}
    for i, (line, form) in enumerate(zip(lines, forms)):
        if form[-1] == "-" and "H" not in form and form[1] not in "01" and len(line) <= 120 and not _thai(line):
            head = tuple(tokens(line)[:2])
            if len(head) == 2 and all(1 < len(w) <= KEYWORD for w in head) and not head[0].isdecimal():
                heads.setdefault(head, []).append(i)
    return {i for own in heads.values() if len(own) >= 4 for i in own}


def _drilled(units: list[list[str]]) -> set[int]:
    """Runs that put ever the same few keywords together, as sentences do not.

    A keyword makes up a twenty-fifth of all words, so there are 25 at most.  Runs of keywords alone count if they come in
    many forms for so few words; a sentence that is merely repeated comes in one.
    """
    if len(units) < 3:
        return set()
    counts: Counter = Counter()
    for words in units:
        counts.update(words)
    least = max(5, (counts.total() - sum(n for w, n in counts.items() if w.isdecimal())) / 25)
    keywords = {w for w, n in counts.items() if n >= least and len(w) <= KEYWORD and not w.isdecimal()}
    if not keywords:
        return set()
    found = {i for i, words in enumerate(units) if words and sum(map(keywords.__contains__, words)) >= 0.7 * len(words)}
    forms = {tuple(w for w in units[i] if not w.isdecimal()) for i in found}
    # A run that says the same twice is of that kind whatever its form.
    twice = sum(1 for i in found if _twice(units[i]))
    return found if len(forms) + twice >= 5 and len(keywords) <= 3 * (len(forms) + twice) else set()


def _twice(words: list[str]) -> bool:
    half = len(words) // 2
    return half > 0 and words[:half] == words[-half:]


def shapes(text: str) -> Counter:
    """Characters (white space aside) of a page by shape: of its lines, and run by run where they read like sentences."""
    lines = [x for x in _lines(plain(text)) if x and not x.isspace()]
    held: Counter = Counter()
    exempt = honest(lines)
    forms = [shape(x, e) for x, e in zip(lines, exempt)]
    for i in _alike(lines, forms):
        if not is_stuffing(forms[i]):
            forms[i] = shape(lines[i], alike=True)
    rest = []
    for line, form in zip(lines, forms):
        if "H" in form or is_stuffing(form):
            held[form] += sum(map(len, line.split()))
        else:
            rest.append(line)
    # Keywords strewn into sentences or over broken lines: repetition within one run, or ever the same keywords.
    units = [x for x in _units("\n".join(rest)) if x]
    words = [tokens(x) for x in units]
    drilled = _drilled(words)
    for i, (unit, own) in enumerate(zip(units, words)):
        marks = "R" if repetition(own, REPEATED) >= REPEATED else "D" if i in drilled else ""
        held[f"w{_grade(len(own))}c0i1l0{marks}."] += sum(map(len, unit.split()))
    return held


def share_stuffed(text: str) -> tuple[float, str | None]:
    """Share of the characters that the ``FEW`` largest groups of stuffing hold, and the shape of the largest."""
    held = shapes(text)
    total = held.total()
    groups = sorted(((n, form) for form, n in held.items() if is_stuffing(form)), key=lambda x: (-x[0], x[1]))[:FEW]
    return (sum(n for n, _ in groups) / total, groups[0][1]) if groups and total else (0.0, None)


def stuffing(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` with ``share`` of stuffed characters, the leading ``shape`` of the stuffing and ``stuffed``.

    A null, empty or blank text has share 0.  Texts are judged as wholes, whatever their length; repeated rows stay
    repeated; other columns are dropped.  An empty table gives an empty table.
    """

    @F.pandas_udf("share double, shape string")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            # Copies within a batch are judged once.
            known: dict[str | None, tuple[float, str | None]] = {None: (0.0, None), "": (0.0, None)}
            yield pd.DataFrame([found if (found := known.get(t)) else known.setdefault(t, share_stuffed(t)) for t in part], columns=["share", "shape"])

    rows = df.select(key, F.col(text).cast("string").alias("_text")).select(key, judged("_text").alias("_j"))
    return rows.select(key, "_j.share", "_j.shape", (F.col("_j.share") > SHARE).alias("stuffed"))
