"""Language of texts and of the stretches of mixed texts, by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram is its letters' vectors, each permuted by its position and
bound by multiplication; a text is the bundle (weighted sum) of its n-grams; a language prototype is the bundle of its
training texts.  A text has the language whose prototype has the greatest cosine with it.

As bundling is linear, the dot product of a text and a prototype is the sum of the dot products of its n-grams, which
are worked out once for each distinct n-gram and word.  So a text costs one lookup a word, whatever the dimension.  The
length of its bundle comes from how often each n-gram stands in it, as vectors of different n-grams are all but orthogonal.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taproot.llm.sentences import SentenceModel, frequent, split, tally
from taproot.plans.lineage import cut

#: Dimension of the vectors, and lengths of the n-grams.
DIMENSION, LENGTHS, UNSPACED_LENGTHS = 4096, (2, 3, 4), (1, 2, 3)
#: Labelled texts of each language that prototypes are bundled from, at most; all of them distinct.
TRAIN_ROWS = 500
#: Weight of a capitalised word inside a sentence, which may be a name.
NAME = 0.25
#: How sharply the confidence may fall with the distance between cosines; the labelled texts choose.
SHARPNESS = (4.0, 6.0, 9.0, 13.0, 20.0, 30.0, 45.0, 65.0, 100.0)
#: Confidence below which a sentence is doubtful.
DOUBT = 0.6
#: Words and n-grams that a worker remembers.
REMEMBERED = 500_000

_UNSPACED = "฀-๿ぁ-ヿ㐀-䶿一-鿿"
_words = re.compile(rf"[{_UNSPACED}]+|[^\W\d_{_UNSPACED}]+(?:[’'`][^\W\d_{_UNSPACED}]+)*").findall
_unspaced = re.compile(f"[{_UNSPACED}]").search
_ended = re.compile(r"[.!?…。！？][\"'“”»’›」』)\]\s]*\Z").search


class Letters:
    """Random vectors of letters, made from their code points alone, and permuted by a letter's position in its n-gram."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension
        self.known: dict[tuple[str, int], np.ndarray] = {}

    def __call__(self, letter: str, position: int = 0) -> np.ndarray:
        v = self.known.get((letter, position))
        if v is None:
            if position:
                v = np.roll(self(letter), position)
            else:
                v = np.random.default_rng(ord(letter)).integers(0, 2, self.dimension, np.int8) * np.int8(2) - np.int8(1)
            self.known[letter, position] = v
        return v

    def ngram(self, letters: str) -> np.ndarray:
        out = self(letters[0])
        for i, letter in enumerate(letters[1:], 1):
            out = out * self(letter, i)
        return out.astype(np.float32)


def telling(text: str) -> tuple[list[str], bool]:
    """The words of a text that tell its language, and whether capitals may mark names in it.

    Latin words beside another script stay out.  In a text all of capitals they mark nothing.
    """
    words = _words(text)
    if not text.isascii():
        other = [w for w in words if w[0] > "ʯ"]
        if other and len(other) < len(words) and 2 * sum(map(len, other)) >= sum(map(len, words)) - sum(map(len, other)):
            words = other
    return words, not text.isupper()


def is_name(word: str, first: bool) -> bool:
    """Whether a word may be a name: it is capitalised, as a first word all of capitals."""
    return word[0].isupper() and (not first or len(word) >= 4 and word.isupper())


def ngrams(word: str) -> list[str]:
    """N-grams of a word; a space stands for either end, which scripts without spaces don't have."""
    padded, lengths = (word, UNSPACED_LENGTHS) if _unspaced(word) else (f" {word} ", LENGTHS)
    return [padded[i : i + n] for n in lengths for i in range(len(padded) - n + 1)]


@dataclass(frozen=True)
class LanguageModel:
    """Prototypes, one row for each language, of length 1 each and centred on their mean; and the sharpness of confidence."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    sharpness: float = 60.0


def bundle(texts: dict[str, list[str]], dimension: int = DIMENSION) -> LanguageModel:
    """Prototypes of the languages that have texts.  The square root of its share keeps no n-gram from drowning others."""
    letters, languages = Letters(dimension), tuple(sorted(k for k, v in texts.items() if v))
    counts: list[dict[str, float]] = []
    for k in languages:
        held: dict[str, float] = {}
        for t in texts[k]:
            words, named = telling(t)
            for i, w in enumerate(words):
                weight = NAME if named and is_name(w, i == 0) else 1.0
                for g in ngrams(w.lower()):
                    held[g] = held.get(g, 0.0) + weight
        counts.append(held)
    rows = np.zeros((len(languages), dimension), np.float32)
    grams = sorted(set().union(*counts))
    totals = np.array([max(1.0, sum(c.values())) for c in counts], np.float32)
    for i in range(0, len(grams), 1024):
        part = grams[i : i + 1024]
        shares = np.array([[c.get(g, 0.0) for g in part] for c in counts], np.float32) / totals[:, None]
        rows += np.sqrt(shares) @ np.stack([letters.ngram(g) for g in part])
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    if len(languages) > 1:
        rows -= rows.mean(axis=0)
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    return LanguageModel(languages, rows)


class Classifier:
    """Cosines of texts with prototypes; remembers words up to a bound."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.letters = Letters(model.prototypes.shape[1])
        self._forget()

    def _forget(self) -> None:
        self.grams: dict[str, int] = {}
        self.dots: list[np.ndarray] = []
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.languages)), np.float32)
        # The n-grams of each word: where they begin in the pool, and how many there are.
        self.pool, self.used = np.zeros(1 << 16, np.int64), 0
        self.first, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        # Whether each word may be a name inside a sentence, and at its beginning.
        self.inside, self.leading = np.zeros(1024, bool), np.zeros(1024, bool)

    def _add(self, word: str) -> int:
        at = self.place[word] = len(self.place)
        if at >= len(self.table):
            own = (self.table, self.first, self.size, self.inside, self.leading)
            self.table, self.first, self.size, self.inside, self.leading = (np.concatenate([x, np.zeros_like(x)]) for x in own)
        self.inside[at], self.leading[at] = is_name(word, False), is_name(word, True)
        found = ngrams(word.lower())
        while self.used + len(found) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        for i, gram in enumerate(found, self.used):
            no = self.grams.get(gram)
            if no is None:
                no = self.grams[gram] = len(self.dots)
                self.dots.append(self.model.prototypes @ self.letters.ngram(gram))
            self.table[at] += self.dots[no]
            self.pool[i] = no
        self.first[at], self.size[at] = self.used, len(found)
        self.used += len(found)
        return at

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cosine of each text with each prototype, and its number of words; a text without letters has zeros."""
        if len(self.place) > REMEMBERED or len(self.grams) > REMEMBERED:
            self._forget()
        ids: list[int] = []
        counts, named = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        get, add = self.place.get, self._add
        for i, text in enumerate(texts):
            words, named[i] = telling(text)
            counts[i] = len(words)
            ids += [at if (at := get(w)) is not None else add(w) for w in words]
        cosines = np.zeros((len(texts), len(self.model.languages)), np.float32)
        full = np.flatnonzero(counts)
        if len(full):
            word = np.array(ids)
            starts = (np.cumsum(counts) - counts)[full]
            name = self.inside[word]
            name[starts] = self.leading[word[starts]]
            name &= np.repeat(named, counts)
            sums = np.add.reduceat(self.table[word] * np.where(name, np.float32(NAME), np.float32(1))[:, None], starts, axis=0)
            length = np.sqrt(self._squares(word, name, counts) * self.letters.dimension)[full]
            cosines[full] = sums / np.maximum(length, 1e-9)[:, None]
        return cosines, counts

    def _squares(self, word: np.ndarray, name: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the squared weights of the distinct n-grams of each text."""
        sizes = self.size[word]
        ends = np.cumsum(sizes)
        grams = self.pool[np.repeat(self.first[word] - (ends - sizes), sizes) + np.arange(ends[-1])]
        text = np.repeat(np.repeat(np.arange(len(counts)), counts), sizes)
        # Text, n-gram and kind of word in one number, so that one sort brings equal n-grams of a text together.
        keys = np.sort(((text << 32) + grams) * 2 + np.repeat(name, sizes))
        fresh = np.flatnonzero(np.append(True, keys[1:] >> 1 != keys[:-1] >> 1))
        weight = np.add.reduceat(np.where(keys & 1, NAME, 1.0), fresh)
        return np.bincount(keys[fresh] >> 33, weight * weight, len(counts))


_held: list[Classifier] = []


def judge_of(model: LanguageModel) -> Classifier:
    """The classifier of a model, kept from task to task of a worker."""
    if not _held or _held[0].model is not model:
        _held[:] = [Classifier(model)]
    return _held[0]


def is_whole(sentence: str, words: int) -> bool:
    """Whether a span reads as a sentence, not a heading, label or name: it ends like one or has enough words."""
    if _unspaced(sentence):
        return len(sentence) >= 6
    return words >= 4 and (words >= 6 or _ended(sentence) is not None)


Run = tuple[int, int, str, float]


def stretches(texts: list[str | None], classifier: Classifier, model: SentenceModel) -> list[list[Run]]:
    """Runs of whole sentences of one language in each text: start, end, language, confidence (the mean over their letters)."""
    spans = [split(t, model) if t else [] for t in texts]
    if not len(classifier.model.languages):
        return [[] for _ in texts]
    # Each distinct sentence is judged once.
    seen: dict[str, int] = {}
    place = [seen.setdefault(t[a:b], len(seen)) for t, found in zip(texts, spans) for a, b in found]
    parts = list(seen)
    cosines, words = classifier(parts)
    odds = np.exp(classifier.model.sharpness * (cosines - cosines.max(axis=1, keepdims=True)))
    shares = odds / odds.sum(axis=1, keepdims=True)
    good = [bool(n) and is_whole(p, n) for p, n in zip(parts, words.tolist())]
    first, sure_of = shares.argmax(axis=1).tolist(), shares.max(axis=1).tolist()
    whole, best, confidence = [good[i] for i in place], [first[i] for i in place], [sure_of[i] for i in place]
    names = classifier.model.languages
    out, k = [], 0
    for found in spans:
        if len(found) > 1:
            own = [i for i in range(k, k + len(found)) if whole[i]]
            sure = [i for i in own if confidence[i] >= DOUBT]
            if 0 < len(sure) < len(own):
                # A doubtful sentence takes the likeliest language of the sure ones around it.
                there = sorted({best[i] for i in sure})
                for i in own:
                    if confidence[i] < DOUBT:
                        best[i] = max(there, key=shares[place[i]].__getitem__)
                        confidence[i] = float(shares[place[i], best[i]])
        runs: list[Run] = []
        weight = 0
        for a, b in found:
            if whole[k]:
                lang, own_share = names[best[k]], confidence[k]
                if runs and runs[-1][2] == lang:
                    start, _, _, before = runs[-1]
                    runs[-1] = (start, b, lang, (before * weight + own_share * (b - a)) / (weight + b - a))
                    weight += b - a
                else:
                    runs.append((a, b, lang, own_share))
                    weight = b - a
            k += 1
        out.append(runs)
    return out


def learn(df: DataFrame, text: str, lang: str, *, rows: int = TRAIN_ROWS, least_length: int = 40) -> tuple[LanguageModel, SentenceModel]:
    """Both models in one pass over the texts: prototypes, and what opens and closes sentences.

    Prototypes come from at most ``rows`` distinct texts of each label of ``lang`` (null: not labelled), those of the least
    hashes; copies of a text count once, however many there are.  Each task sends no more than ``rows`` texts of a label.
    Labels may be wrong here and there: after a first round only texts whose prototype agrees with their label count.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        kept: dict[str, dict[str, int]] = {}
        bar: dict[str, int] = {}
        for batch in batches:
            tally(batch["t"], held)
            for t, label in zip(batch["t"], batch["lang"]):
                if label and t and len(t) >= least_length and (h := xxhash.xxh3_64_intdigest(t) >> 1) < bar.get(label, 1 << 63):
                    own = kept.setdefault(label, {})
                    own[t] = h
                    if len(own) >= 2 * rows:
                        own = kept[label] = dict(sorted(own.items(), key=lambda x: (x[1], x[0]))[:rows])
                        bar[label] = max(own.values())
            if len(held) > 200_000:
                yield frame(held, {})
                held = Counter()
        yield frame(held, kept)

    def frame(held: Counter, kept: dict[str, dict[str, int]]) -> pd.DataFrame:
        found = [(kind, word, None, n, 0) for (kind, word), n in held.items()]
        for label, own in kept.items():
            found += [(3, t, label, 1, h) for t, h in sorted(own.items(), key=lambda x: (x[1], x[0]))[:rows]]
        return pd.DataFrame(found, columns=["kind", "word", "lang", "n", "h"])

    parts = df.select(F.col(text).cast("string").alias("t"), F.col(lang).alias("lang")).where("t is not null").mapInPandas(count, "kind int, word string, lang string, n long, h long")
    counted = cut(parts.groupBy("kind", "word", "lang").agg(F.sum("n").alias("n"), F.min("h").alias("h")))
    ranked = counted.where("kind = 3").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "word")))
    texts: dict[str, list[str]] = {}
    for row in ranked.where(F.col("rank") <= rows).select("lang", "word").collect():
        texts.setdefault(row.lang, []).append(row.word)
    return refine(texts), frequent(counted.where("kind < 3"))


def refine(texts: dict[str, list[str]]) -> LanguageModel:
    """Prototypes from the texts that agree with those of all, with the sharpness under which the labels are likeliest.

    For the sharpness every other text is held out and judged by prototypes of the rest.
    """
    if not any(texts.values()):
        return LanguageModel((), np.zeros((0, DIMENSION), np.float32))
    first = bundle(texts)
    judge = Classifier(first)
    kept: dict[str, list[str]] = {}
    for lang, own in sorted(texts.items()):
        cosines, _ = judge(own)
        agreed = [t for t, x in zip(own, cosines.argmax(axis=1)) if first.languages[x] == lang]
        kept[lang] = agreed or own
    whole = bundle(kept)
    half = Classifier(bundle({k: sorted(v)[::2] for k, v in kept.items()}))
    held = [(t, k) for k, v in texts.items() for t in sorted(v)[1::2] if k in half.model.languages]
    if not held or len(half.model.languages) < 2:
        return whole
    cosines, _ = half([t for t, _ in held])
    own = np.array([half.model.languages.index(k) for _, k in held])
    # As many labels are taken for wrong as disagree with the judge.
    wrong = min(0.5, max(0.01, float((cosines.argmax(axis=1) != own).mean())))
    best, least = whole.sharpness, np.inf
    for sharpness in SHARPNESS:
        odds = np.exp(sharpness * (cosines - cosines.max(axis=1, keepdims=True)))
        share = (odds / odds.sum(axis=1, keepdims=True))[np.arange(len(own)), own]
        loss = -np.log((1 - wrong) * share + wrong / len(half.model.languages)).mean()
        if loss < least:
            best, least = sharpness, loss
    return LanguageModel(whole.languages, whole.prototypes, best)


def languages(df: DataFrame, keys: list[str], text: str, model: LanguageModel, sentence_model: SentenceModel) -> DataFrame:
    """``keys`` with ``stretches``: array of ``start_at, end_at, lang, confidence`` of each run of one language.

    Positions are code points.  A null or blank text, or one without a whole sentence, has no stretches.  Texts of any
    length are read as a whole.  Repeated rows stay repeated; other columns are dropped.  An empty table gives an empty
    table, and without any labelled text there are no languages to find.  Both models are of bounded size.
    """
    shared = df.sparkSession.sparkContext.broadcast((model, sentence_model))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, marks = shared.value
        classifier = judge_of(profiles)
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                rows = stretches(batch.column(len(keys)).to_pylist(), classifier, marks)
                runs = [r for row in rows for r in row]
                offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
                start, end, lang, sure = zip(*runs) if runs else ((), (), (), ())
                fields = [pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(lang, pa.string()), pa.array(sure, pa.float64())]
                own = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start_at", "end_at", "lang", "confidence"]))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], own], names=[*keys, "stretches"])

    # A map and not a column, so that no later filter has the texts read once more.
    rows = df.select(*keys, F.col(text).cast("string").alias("_text"))
    kept = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes if c != "_text")
    return rows.mapInArrow(found, f"{kept}, stretches array<struct<start_at:int,end_at:int,lang:string,confidence:double>>")
