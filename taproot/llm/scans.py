"""Repair of text from scanned pages by a noisy-channel model.

Printed lines are sorted into running text and page furniture; running headers are told by standing in many texts of a
document, or by its titles.  Words cut at line ends are put together.  The words of a line are then decoded by Viterbi: a
hidden word goes through a channel that confuses characters, each confusion with its own probability; the language model is
made of the words, pairs of words and letters of the whole corpus.  The probabilities are estimated from the corpus by
expectation and maximisation over words that can be misreadings of others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot.plans.lineage import cut

#: A word or pair of words belongs to the language model from this share of all words on (and from LEAST times), so the
#: model has at most 1 / SHARE of either.
SHARE, LEAST = 2e-6, 4
#: Characters as they stand in print, and what a scan makes of them.
CONFUSIONS = (
    ("e", "c"), ("t", "f"), ("n", "ri"), ("a", "@"), ("i", "l"), ("s", "ſ"), ("u", "n"), ("o", "0"), ("d", "cl"), ("l", "1"), ("g", "q"),
    ("c", "¢"), ("h", "b"), ("m", "rn"), ("w", "vv"), ("D", "I)"), ("rn", "m"), ("S", "5"), ("B", "8"), ("I", "|"), ("ü", "ii"), ("O", "0"),
    ("ß", "B"), ("I", "1"), ("l", "|"), ("i", "|"), ("i", "1"), ("I", "l"), ("l", "I"), ("E", "3"), ("A", "4"), ("G", "6"), ("Z", "2"),
)
#: Probability of a confusion before anything is counted, how many characters that is worth, and rounds of estimation.
CHANNEL, PRIOR_COUNT, ROUNDS = 1e-3, 1_000.0, 5
#: Probability that a word is printed with its letters spaced out.
SPACING = 1e-3
#: Logarithm of the probability of a new word, and what a letter trigram counts before it is seen.
NEW_WORD, SMOOTH = math.log(0.01), 1.0
#: A word that comes so many times less often than one it can be a misreading of, is one.
RATIO = 40
#: Texts of a document that a line must stand in to be a running header, and the longest such line.
RUNNING, HEADER = 2, 80

_EDGE = ".,;:!?()\"„“”«»‘’…¿¡[]。！？、，"
_HYPHENS = "-‐‑­¬"
_GOING_ON = ",;" + _HYPHENS
_breaks = re.compile("\r\n|[\n\r  \x0b\x0c\x85]").split
_odd = re.compile(r"[@¢ſ|]")
_letters = re.compile(r"[^\W\d_]")
_spaced = re.compile(r"(?<!\S)(?:[^\W\d_] ){3,}[^\W\d_](?!\w)")
_digit_in = re.compile(r"[a-zà-ÿ][01][a-zà-ÿ]")
# Page numbers, digits misread as letters included.
_N = r"(?:[\dlIO|]{1,4}|[ivxlIVX|]{1,6})"
_PAGE = rf"(?:[\[(–—-]\s*{_N}\s*[\])–—-]|(?:S|Seite|p|P|Page|P[áa]g|Pagina|Página|pagina|стр|с|Стр)\.?\s*{_N}(?:\s*(?:von|of|sur|de|di|van|из|/)\s*{_N})?)"
_page = re.compile(rf"\s*(?:{_PAGE}|{_N})\s*\Z").match
_page_after = re.compile(rf"(.*?\S)\s{{2,}}(?:{_PAGE}|{_N})\s*\Z").match
_page_before = re.compile(rf"(?:{_PAGE}|{_N})\s{{2,}}(\S.*)\Z").match
_bare = re.compile(r"\s*\d+\s*\Z").match
_digits = re.compile(r"\d+")
_parted = re.compile(r"\S\s+[·|]\s+\S|©").search
_year = re.compile(r"\s*\|\s*[\dlIO|]{4}\s*\Z")
_mark = re.compile(r"\s*[•·▪◦‣*]\s").match
_ended = re.compile(r"[.!?…:。！？][\"'“”»’›」』)\]\s]*\Z").search
_FOLD = str.maketrans({"¢": "e", "c": "e", "f": "t", "@": "a", "l": "i", "1": "i", "|": "i", "ſ": "s", "5": "s", "n": "u", "0": "o", "q": "g", "b": "h", "8": "h"})
_CONNECTIVES = frozenset("und oder bzw sowie and or et ou y o e en of и или".split())


def fold(line: str) -> str:
    """A line without case, spaces and marks, and with characters that scans confuse made one."""
    s = line.replace("I)", "D").casefold()
    for right, wrong in (("m", "rn"), ("d", "cl"), ("n", "ri"), ("w", "vv"), ("ü", "ii")):
        s = s.replace(wrong, right)
    return re.sub(r"[\W_]+", "", s.translate(_FOLD))


@dataclass
class Page:
    """A text in lines: the running ones, and which kinds of furniture it holds."""

    lines: list[str] = field(default_factory=list)
    kinds: set[str] = field(default_factory=set)


def printed(text: str) -> list[str]:
    return [x for x in (x.strip() for x in _breaks(text)) if x]


def without_number(line: str) -> tuple[str, bool]:
    """A line without the page number beside it, and whether it had one."""
    m = _page_after(line) or _page_before(line)
    return (m[1], True) if m else (line, False)


def key(line: str) -> str:
    """What copies of a line that differ in numbers have in common."""
    return fold(_digits.sub("", line))


def may_run(line: str) -> bool:
    """Whether a line is short enough for a header and doesn't end like a sentence or a part of one."""
    return 5 <= len(line) <= HEADER and line[-1] not in _GOING_ON and _ended(line) is None


def layout(text: str, titles: list[str], running: frozenset[str] = frozenset(), model: LineModel | None = None) -> Page:
    """Tell running text from furniture.  ``titles`` are the folded titles of the document, ``running`` the keys of its headers.

    A header that stands in the document but once is told by its parts, set off by a point or bar, if the corpus knows it
    as going on neither with the line before nor with that after it.
    """
    full = printed(text)
    page = Page()
    if len(full) < 2:
        page.lines = full
        return page
    for i, line in enumerate(full):
        before = full[i - 1] if i else ""
        if _page(line):
            # A bare number under a label belongs to a figure.
            if not (_bare(line) and before.endswith(":")):
                page.kinds.add("page_number")
                continue
        body, numbered = without_number(line)
        alone = model is not None and _parted(body) and may_run(body) and not any(reads_on(a, b, model) for a, b in ((before, body), (body, full[i + 1] if i + 1 < len(full) else "")) if a and b)
        if alone or _header(body, titles, running):
            page.kinds.add("header")
            if numbered:
                page.kinds.add("page_number")
            continue
        page.lines.append(line)
    if not page.lines:
        # Nothing but what looks like furniture is the text itself.
        return Page(full)
    return page


def _header(line: str, titles: list[str], running: frozenset[str]) -> bool:
    if not may_run(line):
        return False
    own = key(line)
    if own in running:
        return True
    bare = _year.sub("", line)
    folded = fold(bare) if bare != line or _digits.search(line) else own
    return folded in titles or any(
        len(x) >= 8 and abs(len(x) - len(t)) <= 2 and SequenceMatcher(None, x, t, False).ratio() >= 0.85 for x, near in ((folded, titles), (own, running)) for t in near
    )


@dataclass(frozen=True)
class LineModel:
    """Counts of words and of pairs of words, and of all words; logarithms of the confusions; counts of letter trigrams."""

    words: dict[str, int] = field(default_factory=dict)
    pairs: dict[tuple[str, str], int] = field(default_factory=dict)
    total: int = 1
    channel: dict[tuple[str, str], float] = field(default_factory=lambda: dict.fromkeys(CONFUSIONS, math.log(CHANNEL)))
    letters: dict[str, int] = field(default_factory=dict)

    def new(self, word: str) -> float:
        """Logarithm of the probability of a word that the model lacks, by its letters."""
        get, marked = self.letters.get, f"\x02\x02{word}\x03"
        n = get("", 1)
        return NEW_WORD + sum(math.log((get(marked[i : i + 3], 0) + SMOOTH * (get(marked[i + 2], 0) + 1) / n) / (get(marked[i : i + 2], 0) + SMOOTH)) for i in range(len(marked) - 2))


def trigrams(words: dict[str, int]) -> dict[str, int]:
    """How often letter trigrams, their first two letters and single letters come in the different words; "" has all letters."""
    held: Counter = Counter()
    for word in words:
        marked = f"\x02\x02{word}\x03"
        for i in range(len(marked) - 2):
            held[marked[i : i + 3]] += 1
            held[marked[i : i + 2]] += 1
            held[marked[i + 2]] += 1
            held[""] += 1
    return dict(held)


def core(token: str) -> str:
    return token.strip(_EDGE)


def undo(word: str) -> list[tuple[str, tuple[str, str]]]:
    """What a word may have been before one confusion, and which."""
    out = []
    for confusion in CONFUSIONS:
        right, wrong = confusion
        at = word.find(wrong)
        while at >= 0:
            out.append((word[:at] + right + word[at + len(wrong) :], confusion))
            at = word.find(wrong, at + 1)
    return out


def variants(word: str, model: LineModel) -> list[tuple[str, float]]:
    """Words of the model that a scan may have turned into ``word``, with the logarithm of the confusions (one or two)."""
    found: dict[str, float] = {}
    first = undo(word)
    for x, c in first:
        if x in model.words:
            found[x] = max(found.get(x, -math.inf), model.channel[c])
    for x, c in first:
        for y, d in undo(x):
            if y != word and y in model.words:
                found[y] = max(found.get(y, -math.inf), model.channel[c] + model.channel[d])
    return sorted(found.items())


def estimate(model: LineModel) -> LineModel:
    """Probabilities of the confusions: how often words read as rarer ones, against how often their characters come.

    Expectation: each rare word is a misreading of the more frequent ones that one confusion leads to, or a word of its own,
    in proportion to their probabilities.  Maximisation: shares of the characters that could have gone wrong.
    """
    seen = Counter()
    for word, n in model.words.items():
        for right in {c[0] for c in CONFUSIONS}:
            if right in word:
                seen[right] += n * word.count(right)
    origins = []
    for word, n in model.words.items():
        found = [(c, model.words[x]) for x, c in undo(word) if model.words.get(x, 0) >= RATIO * n]
        if found:
            origins.append((n, math.exp(model.new(word)), found))
    channel = dict(model.channel)
    for _ in range(ROUNDS):
        counts: Counter = Counter()
        for n, own, found in origins:
            weights = [math.exp(channel[c]) * m / model.total for c, m in found]
            whole = own + sum(weights)
            for (c, _), w in zip(found, weights):
                counts[c] += n * w / whole
        channel = {c: math.log((counts[c] + CHANNEL * PRIOR_COUNT) / (seen[c[0]] + PRIOR_COUNT)) for c in CONFUSIONS}
    return LineModel(model.words, model.pairs, model.total, channel, model.letters)


def clean(model: LineModel) -> LineModel:
    """Drop words that are frequent misreadings of far more frequent words, and estimate the confusions from them."""
    model = estimate(LineModel(model.words, model.pairs, model.total, model.channel, trigrams(model.words)))
    wrong = set()
    for word, n in model.words.items():
        least = (1 if _odd.search(word) else RATIO) * n
        if any(model.words.get(x, 0) >= least for x, _ in undo(word)):
            wrong.add(word)
    words = {w: n for w, n in model.words.items() if w not in wrong}
    pairs = {p: n for p, n in model.pairs.items() if p[0] in words and p[1] in words}
    return LineModel(words, pairs, model.total, model.channel, trigrams(words))


class Decoder:
    """Viterbi over the candidate words of a line; remembers candidates up to a bound."""

    def __init__(self, model: LineModel):
        self.model = model
        self.known: dict[str, list[tuple[str, float]]] = {}

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """Candidates with the logarithm of the channel; the word itself comes first.

        A word with characters that print lacks may also be a new one: whatever one or two confusions make of it.
        """
        got = self.known.get(word)
        if got is None:
            got = [(word, 0.0)]
            n = self.model.words.get(word, 0)
            if len(word) >= 2 and _letters.search(word) is not None:
                got += [(c, k) for c, k in variants(word, self.model) if self.model.words[c] > n]
                if not n and strange(word):
                    got += self._fresh(word, {c for c, _ in got})
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = got
        return got

    def _fresh(self, word: str, there: set[str]) -> list[tuple[str, float]]:
        """New words behind a strange one: confusions undone, best first, until nothing strange is left."""
        found: dict[str, float] = {}
        beam = [(word, 0.0)]
        for _ in range(3):
            step: dict[str, float] = {}
            for x, k in beam:
                for y, c in undo(x):
                    if y not in there and len(strange(y)) < len(strange(x)):
                        step[y] = max(step.get(y, -math.inf), k + self.model.channel[c])
            beam = sorted(step.items(), key=lambda z: (-z[1] - self.model.new(z[0]), z[0]))[:8]
            found |= {y: k for y, k in beam if not strange(y)}
        return sorted(found.items())

    def _word(self, word: str) -> float:
        n = self.model.words.get(word)
        return n / self.model.total if n else math.exp(self.model.new(word))

    def joins(self, letters: list[str]) -> bool:
        """Whether single letters in a row are one word spaced out."""
        return math.log(SPACING) + math.log(self._word("".join(letters))) > sum(math.log(self._word(x)) for x in letters)

    def _step(self, before: str, word: str) -> float:
        model = self.model
        alone = self._word(word)
        n = model.words.get(before)
        if not n:
            return math.log(alone)
        return math.log(0.6 * model.pairs.get((before, word), 0) / n + 0.4 * alone)

    def __call__(self, words: list[str]) -> list[str]:
        """The most likely words behind the given ones."""
        lattice = [self.candidates(w) for w in words]
        if all(len(x) == 1 for x in lattice):
            return words
        scores = [ch + self._step("", c) for c, ch in lattice[0]]
        back: list[list[int]] = []
        for i in range(1, len(lattice)):
            row, links = [], []
            for c, ch in lattice[i]:
                options = [s + self._step(p, c) for s, (p, _) in zip(scores, lattice[i - 1])]
                best = max(range(len(options)), key=options.__getitem__)
                row.append(options[best] + ch)
                links.append(best)
            scores = row
            back.append(links)
        at = max(range(len(scores)), key=scores.__getitem__)
        out = [lattice[-1][at][0]]
        for i in range(len(lattice) - 2, -1, -1):
            at = back[i][at]
            out.append(lattice[i][at][0])
        return out[::-1]


def strange(word: str) -> list[str]:
    """Characters of a word that print lacks: odd ones, and digits between small letters."""
    return _odd.findall(word) + _digit_in.findall(word)


_held: list[Decoder] = []


def decoder_of(model: LineModel) -> Decoder:
    """The decoder of a model, kept from task to task of a worker."""
    if not _held or _held[0].model is not model:
        _held[:] = [Decoder(model)]
    return _held[0]


def _cut(left: str, right: str, mark: str, words: dict[str, int]) -> bool:
    """Whether a hyphen at the end of a line cuts a word that is written without one."""
    a, b = left.lstrip(_EDGE), right.rstrip(_EDGE)
    if not a or not b or not a[-1].isalpha():
        return False
    if mark in "­¬":
        return True
    if not b[0].islower() and not (a.isupper() and b.isupper() and len(a) > 1):
        return False
    if b.casefold() in _CONNECTIVES:
        return False
    joined, hyphened = words.get(a + b, 0), words.get(f"{a}-{b}", 0)
    if hyphened > joined:
        return False
    return joined > 0 or not ("." in a or "-" in a)


def repair(text: str | None, titles: list[str], decoder: Decoder, running: frozenset[str] = frozenset()) -> tuple[str | None, set[str]]:
    """The text as continuous paragraphs, and the kinds of noise that it held."""
    if text is None:
        return None, set()
    page = layout(text, titles, running, decoder.model)
    kinds = set(page.kinds)
    paragraphs: list[list[str]] = []
    cut_off = ""
    for i, line in enumerate(page.lines):
        for m in reversed([m for m in _spaced.finditer(line) if decoder.joins(m[0].split())]):
            kinds.add("misread")
            line = line[: m.start()] + m[0].replace(" ", "") + line[m.end() :]
        tokens = line.split()
        if not tokens:
            continue
        label = i and (_bare(line) or page.lines[i - 1].endswith(":") and len(page.lines[i - 1]) < 60 and _bare(line))
        fresh = not paragraphs or _mark(line + " ") or label or _bare(page.lines[i - 1]) and not cut_off
        if fresh and not cut_off:
            paragraphs.append([])
        own = paragraphs[-1]
        if cut_off:
            left, mark = cut_off[:-1], cut_off[-1]
            if _cut(left, tokens[0], mark, decoder.model.words):
                kinds.add("hyphen")
                tokens[0] = left + tokens[0]
            else:
                tokens[0] = left + ("-" if mark != "­" else "") + tokens[0] if tokens[0].casefold().rstrip(_EDGE) not in _CONNECTIVES else f"{left}- {tokens[0]}"
            cut_off = ""
        last = tokens[-1]
        if i + 1 < len(page.lines) and len(last) > 1 and last[-1] in _HYPHENS and last[-2].isalpha():
            cut_off = tokens.pop()
        own += tokens
    if cut_off:
        paragraphs[-1].append(cut_off)
    out = []
    for tokens in paragraphs:
        words = [core(t) for t in tokens]
        read = decoder(words) if words else words
        for j, (word, better) in enumerate(zip(words, read)):
            if word != better:
                tokens[j] = tokens[j].replace(word, better, 1)
                kinds.add("misread")
        if tokens:
            out.append(" ".join(tokens))
    return "\n".join(out), kinds


def learn(df: DataFrame, text: str) -> LineModel:
    """Words and pairs of words of all texts, counted where they are and combined.

    Only what makes up ``SHARE`` of all words, and comes ``LEAST`` times, is sent to the driver: at most 1 / SHARE of
    either, whatever the size of the corpus.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for t in batch["t"]:
                for line in _breaks(t):
                    words = [w for x in line.split() if (w := core(x))]
                    held.update((w, "") for w in words)
                    held.update(zip(words, words[1:]))
                    held["", ""] += len(words)
            if len(held) > 500_000:
                yield frame(held)
                held = Counter()
        yield frame(held)

    def frame(held: Counter) -> pd.DataFrame:
        return pd.DataFrame([(a, b, n) for (a, b), n in held.items()], columns=["a", "b", "n"])

    parts = df.select(F.col(text).cast("string").alias("t")).where("t is not null").mapInPandas(count, "a string, b string, n long")
    counted = cut(parts.groupBy("a", "b").agg(F.sum("n").alias("n")))
    total = counted.where("a = '' and b = ''").agg(F.sum("n")).first()[0] or 0
    kept = counted.where((F.col("a") != "") & (F.col("n") >= max(float(LEAST), total * SHARE))).collect()
    return clean(LineModel({r.a: r.n for r in kept if r.b == ""}, {(r.a, r.b): r.n for r in kept if r.b != ""}, max(1, total)))


def reads_on(left: str, right: str, model: LineModel) -> bool:
    """Whether one line goes on in another: the corpus has the pair of words where they meet."""
    return (core(left.rsplit(None, 1)[-1]), core(right.split(None, 1)[0])) in model.pairs


def running_headers(df: DataFrame, document: str, text: str, model: LineModel) -> DataFrame:
    """``document, running``: keys of the lines that run through the texts of a document.

    Such a line stands in ``RUNNING`` texts or more, not always between the same lines, and in no more than a quarter of
    them does the corpus know the pair of words where it meets the line before or after it, as it does within sentences.
    Counts are combined where they are; a document without such lines has no row.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, t in zip(batch["d"], batch["t"]):
                lines = [without_number(x)[0] for x in printed(t) if not _page(x)]
                if len(lines) < 2:
                    continue
                keys: dict[str, tuple[bool, str]] = {}
                for i, line in enumerate(lines):
                    if may_run(line) and len(own := key(line)) >= 4:
                        after = lines[i + 1] if i + 1 < len(lines) else ""
                        met = i and reads_on(lines[i - 1], line, shared.value) or after and reads_on(line, after, shared.value)
                        keys[own] = bool(met), after
                out += [(doc, k, 1, int(met), after) for k, (met, after) in keys.items()]
            yield pd.DataFrame(out, columns=["d", "k", "n", "met", "after"])

    parts = df.select(F.col(document).alias("d"), F.col(text).cast("string").alias("t")).where("d is not null and t is not null").mapInPandas(count, "d string, k string, n int, met int, after string")
    counted = parts.groupBy("d", "k").agg(F.sum("n").alias("n"), F.sum("met").alias("met"), F.min("after").alias("low"), F.max("after").alias("high"))
    runs = counted.where((F.col("n") >= RUNNING) & (F.col("met") * 4 <= F.col("n")) & (F.col("low") != F.col("high")))
    return runs.groupBy("d").agg(F.collect_list("k").alias("running")).withColumnRenamed("d", document)


def repaired(df: DataFrame, keys: list[str], text: str, titles: str, model: LineModel, running: str | None = None) -> DataFrame:
    """``keys`` with ``repaired`` (paragraphs, one a line) and ``kinds``, the noise found: hyphen, misread, header, page_number.

    ``titles`` is a column of the titles of the row's document, array<string> or null; ``running`` one of the keys that
    :func:`running_headers` found in it.  A null text stays null, an empty
    one empty; neither has noise.  Texts of any length are repaired as wholes.  Repeated rows stay repeated; other columns
    are dropped.  An empty table gives an empty table.  The broadcast model is of bounded size.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = decoder_of(shared.value)
        for part in parts:
            texts, found = [], []
            for t, names, runs in zip(part["_text"], part["_titles"], part["_running"]):
                better, kinds = repair(t, [fold(x) for x in names if x] if names is not None else [], decoder, frozenset(runs) if runs is not None else frozenset())
                texts.append(better)
                found.append(sorted(kinds))
            yield part.drop(columns=["_text", "_titles", "_running"]).assign(repaired=texts, kinds=found)

    rows = df.select(*keys, F.col(text).cast("string").alias("_text"), F.col(titles).alias("_titles"), (F.col(running) if running else F.lit(None).cast("array<string>")).alias("_running"))
    kept = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes if c not in ("_text", "_titles", "_running"))
    return rows.mapInPandas(run, f"{kept}, repaired string, kinds array<string>")
