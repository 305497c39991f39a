"""German and English rules for what a text points at and whether it stands alone."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed word classes and patterns that the results depend on.
ANAPHORS = {
    "de": "er sie es ihn ihm ihr ihnen sein seine seinem seinen seiner seines ihre ihrem ihren ihrer ihres dessen deren derer man",
    "en": "it its he him his she her hers they them their theirs one ones",
}
DEMONSTRATIVES = {
    "de": "dieser diese dieses diesen diesem jener jene jenes jenen jenem solche solcher solches solchen solchem obige obigen obiger genannte genannten genannter "
    "letztere letzteren erstere ersteren besagte besagten derartige derartigen entsprechende entsprechenden",
    "en": "this these those that such said former latter aforementioned above",
}
CONNECTIVES = {
    "de": "jedoch daher deshalb deswegen zudem außerdem ausserdem ferner folglich somit allerdings dennoch hingegen dagegen dabei hierbei hierzu hierfür dazu dafür "
    "darüber demgegenüber dementsprechend demzufolge insbesondere beispielsweise entsprechend andernfalls ansonsten schließlich zunächst anschließend ebenso "
    "ebenfalls trotzdem vielmehr zusätzlich weiterhin abschließend stattdessen",
    "en": "however therefore thus moreover furthermore conversely hence consequently additionally besides nevertheless nonetheless meanwhile finally accordingly "
    "instead similarly likewise otherwise subsequently",
}
PHRASES = (
    "in contrast", "on the contrary", "on the other hand", "as a result", "for example", "for instance", "that said", "in addition", "im gegensatz",
    "darüber hinaus", "zum beispiel", "aus diesem grund", "im folgenden", "vor diesem hintergrund", "auf dieser grundlage",
)
MARKERS = {
    "de": "der die das den dem des und nicht mit von für auf ist sind ein eine werden wird bei durch zur zum oder auch nach",
    "en": "the and not with of for on is are a an be will at by to or also after",
}
FINITE = {
    "de": "ist sind war waren sei seien bin bist seid wird werden wurde wurden wirst werdet hat haben hatte hatten hast habt kann können konnte konnten kannst könnt "
    "soll sollen sollte sollten sollst sollt muss müssen musste mussten musst müsst darf dürfen durfte durften darfst dürft mag mögen möchte möchten will wollen "
    "wollte wollten gibt geben gab gaben zeigt zeigen zeigte zeigten besteht bestehen erfolgt erfolgen gilt gelten",
    "en": "is are was were am be been being has have had does do did can could shall should will would may might must shows show showed gives give gave remains remain",
}
ACRONYM_STOPLIST = "ID OK PDF URL DOI ISBN ISSN USA EU WHO II III IV VI VII VIII IX XI XII MG ML KG CM MM MMHG BMI"
DEFINITE = {"de": r"\b[Dd](?:er|ie|as|en|em|es)\s+([A-ZÄÖÜ][\wÄÖÜäöüß\-]+)", "en": r"\b[Tt]he\s+([a-zA-Z][\w\-]+)"}
ACRONYM = r"\b[A-ZÄÖÜ]{2,}[a-z0-9]*[A-Z0-9]?\b|\b[A-ZÄÖÜ][a-z]?[A-Z][a-z]?\d\w*\b"

_sets = {name: {lang: frozenset(words.split()) for lang, words in table.items()} for name, table in (("anaphor", ANAPHORS), ("demonstrative", DEMONSTRATIVES), ("marker", MARKERS))}
_stop = frozenset(ACRONYM_STOPLIST.split())
_definite = {lang: re.compile(pattern) for lang, pattern in DEFINITE.items()}
_acronym = re.compile(ACRONYM)
_word = re.compile(r"\w+")


class Pointer(NamedTuple):
    """An expression that points at something: ``key`` names what, if anything does."""

    kind: str
    surface: str
    offset: int
    resolved: bool
    key: str


def stem(word: str) -> str:
    return word.lower()[:6]


def language(text: str) -> str:
    """en if the text has more English than German function words, else de."""
    words = [w.lower() for w in _word.findall(text)]
    votes = {lang: sum(w in own for w in words) for lang, own in _sets["marker"].items()}
    return "en" if votes["en"] > votes["de"] else "de"


def pointers(text: str, lang: str | None = None) -> list[Pointer]:
    """Pointers of a text, each resolved or not within it.

    A pronoun is resolved by any noun before it (German: a capitalised word but the first; English: a word of more than
    three letters), a demonstrative if the stem of the next word came before, a definite description likewise, an acronym
    if the text spells it out.
    """
    lang = lang or language(text)
    spots = [(m[0], m.start()) for m in _word.finditer(text)]
    first_at: dict[str, int] = {}
    for word, at in spots:
        first_at.setdefault(stem(word), at)
    noun_from = next((at for i, (w, at) in enumerate(spots) if (w[0].isupper() and i > 0 if lang == "de" else len(w) > 3)), len(text))
    out = []
    for i, (word, at) in enumerate(spots):
        low = word.lower()
        if low in _sets["anaphor"][lang]:
            out.append(Pointer("anaphor", word, at, noun_from < at, ""))
        if low in _sets["demonstrative"][lang]:
            head = spots[i + 1][0] if i + 1 < len(spots) else ""
            out.append(Pointer("demonstrative", word, at, bool(head) and first_at.get(stem(head), at) < at, head))
    named: set[str] = set()
    for m in _definite[lang].finditer(text):
        key = stem(m[1])
        earlier = any(stem(w) == key for w, at in spots if at < m.start()) if key not in named else True
        out.append(Pointer("definite", m[1], m.start(), earlier, m[1]))
        named.add(key)
    for m in _acronym.finditer(text):
        if m[0].upper() not in _stop:
            out.append(Pointer("acronym", m[0], m.start(), expands(m[0], text), m[0]))
    return out


def expands(acronym: str, text: str) -> bool:
    """Whether the text spells an acronym out: in brackets, before brackets, or by the initials of the words before it."""
    quoted = re.escape(acronym)
    if re.search(rf"\(\s*{quoted}\s*\)|\b{quoted}\s*\(", text):
        return True
    initials = [c.lower() for c in acronym if c.isalpha()]
    # Without the acronym in it, all but the last character is what comes before.
    ahead = _word.findall(text[: text.find(acronym)])[-len(initials) :]
    return len(initials) >= 2 and [w[0].lower() for w in ahead] == initials


def profile(text: str) -> tuple[frozenset[str], bool]:
    """Stems of a text, and whether it names anything."""
    stems_ = frozenset(stem(w) for w in _word.findall(text.lower()))
    return stems_, bool(stems_)


def resolves(kind: str, key: str, text: str, offered: tuple[frozenset[str], bool]) -> bool:
    """Whether a text resolves a pointer from elsewhere; every part of a compound key must be there, bare numbers aside."""
    if kind == "acronym":
        return expands(key, text)
    if not key:
        return offered[1]
    parts = [s for s in (stem(w) for w in _word.findall(key.lower())) if not s.isdigit()]
    return bool(parts) and all(p in offered[0] for p in parts)


# --- the same shallow signs as column expressions -----------------------------


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _count_in(words: Column, listed: str) -> Column:
    own = F.array(*[F.lit(w) for w in listed.split()])
    return F.size(F.filter(words, lambda w: F.array_contains(own, w)))


def marker_votes(text: Column, lang: str) -> Column:
    """How many function words of a language a text has."""
    return _count_in(_words(text), MARKERS[lang])


def language_of(text: Column) -> Column:
    words = _words(text)
    return F.when(_count_in(words, MARKERS["en"]) > _count_in(words, MARKERS["de"]), "en").otherwise("de")


def _by_language(text: Column, tables: dict[str, str], test) -> Column:
    return F.when(language_of(text) == "en", test(tables["en"])).otherwise(test(tables["de"]))


def sentence_signs(text: Column) -> dict[str, Column]:
    """Signs that a text isn't a sentence of its own."""
    words = _words(text)
    opened = F.lower(F.regexp_replace(text, r"^[\s\-–—•*·]+", ""))
    first = F.regexp_extract(opened, r"^[^\p{L}\p{N}_]*([\p{L}\p{N}_]+)", 1)
    phrase = F.lit(False)
    for p in PHRASES:
        phrase = phrase | opened.startswith(p)
    letter = F.regexp_extract(F.regexp_replace(text, r"^[\s\-–—•*·§]+", ""), r"^\P{L}*(\p{L})", 1)
    return {
        "no_finite_verb": _by_language(text, FINITE, lambda listed: _count_in(words, listed) == 0),
        "fragment": ~F.trim(text).rlike(r"[.!?]$"),
        "leading_connective": phrase | _by_language(text, CONNECTIVES, lambda listed: first.isin(*listed.split())),
        "lowercase_start": letter.rlike(r"^\p{Ll}"),
    }
