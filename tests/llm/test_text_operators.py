import numpy as np
import pytest

from taproot.llm import bpe, langid, packing, scans, sentences, stuffing, termweight
from taproot.llm.bpe import Encoder, PerfectHash, encode, vocabulary

MODEL = sentences.SentenceModel(
    frozenset({"Die", "Patients", "Geeignete", "Most", "eGFR", "# Minuten", "ตั้งแต"}), frozenset({"Team", "usw", "nötig", "etc", "p.m", "vermerkt", "ลดลง"})
)


def cuts(text):
    return [text[a:b] for a, b in sentences.split(text, MODEL)]


def test_sentences():
    assert cuts("Die Dosis ist ca. 3,5 mg nötig. Geeignete Schuhe usw. Die Kosten.") == ["Die Dosis ist ca. 3,5 mg nötig.", "Geeignete Schuhe usw.", "Die Kosten."]
    assert cuts("„Die Pflege ist wichtig.“, betont das Team. Die Zahl steigt.") == ["„Die Pflege ist wichtig.“, betont das Team.", "Die Zahl steigt."]
    assert cuts("Die Zahl ist nötig.Geeignete Schuhe helfen.") == ["Die Zahl ist nötig.", "Geeignete Schuhe helfen."]
    assert cuts("• Die Zahl steigt an\n• Geeignete Schuhe") == ["Die Zahl steigt an", "Geeignete Schuhe"]
    assert cuts("孕妇应当检查。为什么？他说：“好。”") == ["孕妇应当检查。", "为什么？", "他说：“好。”"]
    assert cuts("Am 28. März wurde Dr. Zarnhoff im U.S. Panel gehört.") == ["Am 28. März wurde Dr. Zarnhoff im U.S. Panel gehört."]
    assert cuts("") == cuts(" \n\t ") == []
    long = "Die Zahl ist nötig. " * 5000
    assert len(cuts(long)) == 5000


def test_sentence_over_many_candidates():
    authors = "Die Liste nennt " + "".join(f"Nr. Ab. Cd. Zarnhoff{i}, " for i in range(60)) + "und das Team."
    assert len(authors) > sentences.LONG and cuts(authors + " Die Zahl steigt.") == [authors, "Die Zahl steigt."]


def test_sentence_operator(spark):
    df = spark.createDataFrame([(1, "Die Zahl ist nötig. Die Zahl steigt.", "x"), (1, "Die Zahl ist nötig. Die Zahl steigt.", "x"), (2, None, "y"), (3, "", "z")], "id int, text string, spans string")
    got = sentences.sentences(df, ["id"], "text", sentences.learn(df, "text")).collect()
    assert sorted((r.id, len(r.spans)) for r in got) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert sentences.learn(df.limit(0), "text") == sentences.SentenceModel()
    assert sentences.sentences(df.limit(0), ["id"], "text", MODEL).count() == 0


SAMPLES = {
    "de": ["Die Dosis wird nach der Mahlzeit gemessen und in das Tagebuch eingetragen.", "Wann steigt der Blutzucker trotz guter Einstellung?"],
    "en": ["The dose should be measured after the meal and noted in the diary.", "When does the glucose rise despite good control of the patients?"],
    "ja": ["食事の前に血糖を測り、手帳に書きとめる。", "高齢の患者さんの目標値はまだ決まっていない。"],
}


def test_languages(spark):
    rows = [(t, lang) for lang, texts in SAMPLES.items() for t in texts] + [(None, "de"), ("kurz", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    model, marks = langid.learn(df, "text", "lang", least_length=5)
    assert model.languages == ("de", "en", "ja") and marks == sentences.learn(df, "text")
    mixed = "Die Dosis wird nach der Mahlzeit gemessen. The dose should be noted in the diary."
    units = spark.createDataFrame([(1, mixed), (2, None), (3, " "), (4, "[1] 12"), (5, SAMPLES["ja"][0])], "id int, text string")
    got = {r.id: [s.lang for s in r.stretches] for r in langid.languages(units, ["id"], "text", model, marks).collect()}
    assert got == {1: ["de", "en"], 2: [], 3: [], 4: [], 5: ["ja"]}
    assert langid.languages(units.limit(0), ["id"], "text", model, MODEL).count() == 0
    nothing, _ = langid.learn(df.limit(0), "text", "lang")
    assert langid.languages(units, ["id"], "text", nothing, MODEL).where("size(stretches) > 0").count() == 0


def test_copies_teach_a_language_once(spark):
    german = [f"Die {x} wird nach der {y} gemessen und in das Heft eingetragen." for x in ("Dosis", "Menge", "Zahl", "Rate") for y in ("Mahlzeit", "Nacht", "Messung", "Pause")]
    english = [f"The {x} should be measured after the {y} and noted in the diary." for x in ("dose", "amount", "number", "rate") for y in ("meal", "night", "visit", "break")]
    copy = "Empfohlen werden Bewegung, Gewichtsabnahme, Rauchverzicht usw."
    rows = [(t, "de") for t in german] + [(t, "en") for t in english] + [(copy, "de")] * 400
    few, _ = langid.learn(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", rows=16)
    judge = langid.Classifier(few)
    for lang, texts in (("de", german), ("en", english)):
        assert [few.languages[i] for i in judge(texts)[0].argmax(axis=1)] == [lang] * len(texts)
    many, _ = langid.learn(spark.createDataFrame(rows[:32] + [(copy, "de")], "text string, lang string"), "text", "lang", rows=16)
    assert np.allclose(few.prototypes, many.prototypes)


def test_cosine_is_that_of_the_bundle():
    model = langid.bundle(SAMPLES)
    judge = langid.Classifier(model)
    texts = ["the dose of the patients the dose the dose the dose", "Die Dosis wird nach der Mahlzeit gemessen", "", "12", "食事の前に血糖を測る"]
    cosines, counts = judge(texts)
    for text, found, n in zip(texts, cosines, counts):
        words, named = langid.telling(text)
        assert n == len(words)
        if not words:
            assert not found.any()
            continue
        names = [named and langid.is_name(w, i == 0) for i, w in enumerate(words)]
        direct = sum((langid.NAME if name else 1.0) * judge.letters.ngram(g) for w, name in zip(words, names) for g in langid.ngrams(w.lower()))
        assert np.allclose(model.prototypes @ direct / np.linalg.norm(direct), found, rtol=0.15, atol=0.01)


WORDS = {"wurde": 900, "gemessen": 500, "Dosis": 400, "Die": 800, "vermerkt": 300, "und": 900, "self-monitoring": 20, "Kosten": 90, "Tage": 80, "Tagen": 50}
LINES = scans.clean(scans.LineModel(WORDS, {("Die", "Dosis"): 300}, 10_000))


def repair(text, titles=()):
    return scans.repair(text, [scans.fold(t) for t in titles], scans.Decoder(LINES))


def test_scans():
    assert repair("Die Dosis wurde gemes-\n[3]\nDiabetes im Alter | 2012\nsen und vermerkt", ["Diabetes im Alter"]) == ("Die Dosis wurde gemessen und vermerkt", {"hyphen", "page_number", "header"})
    assert repair("Die Dosis wurdc gemessen") == ("Die Dosis wurde gemessen", {"misread"})
    assert repair("Die D o s i s wurde") == ("Die Dosis wurde", {"misread"})
    assert repair("Die Messunq wurde")[1] == set() and repair("Die T@gen wurde") == ("Die Tagen wurde", {"misread"})
    assert repair("self-\nmonitoring und Vor-\nund Nachteile")[1] == set()
    assert repair("Die Kosten:\n60\nDie Dosis:\n67")[1] == set()
    assert repair(None) == (None, set()) and repair("") == ("", set()) and repair("Diabetes im Alter", ["Diabetes im Alter"])[1] == set()


def test_confusions_are_estimated():
    words = {f"{x}werden{x}": 5000 for x in "abcdefghij"} | {f"{x}wcrden{x}": 50 for x in "abcdefghij"}
    model = scans.clean(scans.LineModel(words, {}, sum(words.values())))
    assert model.channel["e", "c"] > model.channel["n", "ri"] + 3 and set(model.words) == {w for w in words if "werden" in w}
    assert scans.Decoder(model)(["awcrdena"]) == ["awerdena"]
    # Two confusions in one word, however many or few letters it has.
    assert scans.Decoder(LINES)(["vvurdc"]) == ["wurde"] and scans.Decoder(LINES)(["unc1"]) == ["und"]


def test_planted_noise_is_repaired(spark):
    rng = np.random.default_rng(4)
    nouns, verbs, ends = ("Dosis", "Salbe", "Kontrolle", "Messung", "Schulung"), ("wurde", "sollte", "konnte"), ("gemessen", "vermerkt", "wiederholt", "besprochen")
    clean = [" ".join(f"Die {rng.choice(nouns)} {rng.choice(verbs)} am Morgen {rng.choice(ends)}." for _ in range(3)) for _ in range(3000)]
    rows, want = [], {}
    for i, text in enumerate(clean):
        words, kinds, lines = text.split(), set(), []
        if i % 30 == 0:
            j = int(rng.integers(len(words)))
            for right, wrong in (("e", "c"), ("n", "ri"), ("o", "0")):
                if right in words[j][1:]:
                    words[j] = words[j][0] + words[j][1:].replace(right, wrong, 1)
                    kinds.add("misread")
                    break
        for j in range(0, len(words), 5):
            lines.append(" ".join(words[j : j + 5]))
        if i % 4 == 0:
            lines.insert(1, f"Pflegekreis Nord {1990 + i % 9}   {i % 90 + 1}")
            kinds |= {"header", "page_number"}
        if i % 5 == 0:
            head, tail = lines[-1][:-6], lines[-1][-6:]
            if head[-1:].isalpha() and tail[0].isalpha():
                lines[-1:] = [head + "-", tail]
                kinds.add("hyphen")
        rows.append((f"d{i % 10}", i, "\n".join(lines), None))
        want[i] = (text, kinds)
    df = spark.createDataFrame(rows, "doc string, id int, text string, titles array<string>")
    model = scans.learn(df, "text")
    headed = df.join(scans.running_headers(df, "doc", "text", model), "doc", "left")
    got = {r.id: (r.repaired, set(r.kinds)) for r in scans.repaired(headed, ["id"], "text", "titles", model, "running").collect()}
    assert sum(got[i][0] == want[i][0] for i in want) >= 0.97 * len(want)
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.97 * len(want)
    assert scans.running_headers(df.limit(0), "doc", "text", model).count() == 0


def test_scan_operator(spark):
    df = spark.createDataFrame([(1, "Die Dosis", ["x", None], 0), (1, "Die Dosis", None, 0), (2, None, None, 0)], "id int, text string, titles array<string>, kinds int")
    model = scans.learn(df, "text")
    assert sorted((r.id, r.repaired or "") for r in scans.repaired(df, ["id"], "text", "titles", model).collect()) == [(1, "Die Dosis"), (1, "Die Dosis"), (2, "")]
    assert scans.learn(df.limit(0), "text").words == {} and scans.repaired(df.limit(0), ["id"], "text", "titles", model).count() == 0


def test_log_entropy(spark):
    rows = [("a", "rare rare common"), ("a", "rare"), ("b", "common"), ("c", "common"), ("d", None), (None, "rare")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "record string, text string, term int")
    got = {(r.record, r.term): r for r in termweight.log_entropy(df, "record", "text").collect()}
    assert got["a", "rare"].tf == 3 and got["a", "rare"].score == pytest.approx(np.log(4))
    h = np.log(3) / np.log(4)
    assert got["b", "common"].score == pytest.approx(np.log(2) * (1 - h)) and got["b", "common"].n_records == 3
    assert termweight.log_entropy(df.limit(0), "record", "text").count() == 0
    seen = {(r.record, r.term): r for r in termweight.log_entropy(df, "record", "text", presence=True).collect()}
    assert seen["a", "rare"].tf == 2 and seen["a", "rare"].local == pytest.approx(np.log(3)) and seen["a", "rare"].entropy == 0
    assert seen["a", "common"].entropy == pytest.approx(np.log(3) / np.log(4)) and seen["a", "common"].spread == pytest.approx(1 - np.log(3) / np.log(4))


def test_log_entropy_splits_hot_records_and_terms(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"r{i % 7}", " ".join(f"w{chr(97 + x)}" for x in rng.zipf(1.6, 12) % 26)) for i in range(300)]
    df = spark.createDataFrame(rows, "record string, text string")
    plain = sorted(termweight.log_entropy(df, "record", "text").collect())
    monkeypatch.setattr(termweight, "HOT_TEXTS", 5)
    monkeypatch.setattr(termweight, "PARTS", 4)
    monkeypatch.setattr(termweight, "HOT_TERMS", 50)
    split = sorted(termweight.log_entropy(df, "record", "text").collect())
    assert [r[:4] for r in plain] == [r[:4] for r in split] and np.allclose([r.score for r in plain], [r.score for r in split])


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(5000)]
    table = PerfectHash(keys)
    assert sorted(table(k) for k in keys) == list(range(5000)) and all(table(k) == i for i, k in enumerate(keys))
    assert PerfectHash([])(b"x") in (-1, 0)


def test_bpe_round_trip_and_reference(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(f"{bpe.FOLDER}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    texts = ["Häuser und <|endoftext|> 12.5", "", "  \n x", "नमस्ते 👩‍⚕️", "a" * 5000, "=-" * 3000, "don't  stop", "食事の前"]
    vocab = vocabulary("byte_bpe_50k")
    flat, sizes = Encoder(vocab)(texts)
    ends = np.cumsum(sizes)
    by_id = dict(zip(vocab.ids, vocab.tokens))
    for text, end, n in zip(texts, ends, sizes):
        own = flat[end - n : end].tolist()
        assert own == reference.encode(text, add_special_tokens=False).ids
        assert b"".join(by_id[i] for i in own).decode() == text
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, None])], "id int, text string, ids int")
    got = {r.id: r.ids for r in encode(df, "id", "text").collect()}
    assert got[len(texts)] is None and got[1] == [] and got[0] == flat[: sizes[0]].tolist()
    assert encode(df.limit(0), "id", "text").count() == 0


def test_sum_of_squares():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(0, 101, 3000))[::-1]
    home = packing.sum_of_squares(sizes, 100)
    used = np.bincount(home, weights=sizes)
    assert used.max() <= 100 and len(used) <= np.ceil(sizes.sum() / 100) * 1.1


def test_packing(spark):
    rows = [(i, n, 7) for i, n in enumerate([50, 50, 30, 70, 250, 0, 100])] + [(7, None, 7), (8, -1, 7), (None, 5, 7), (0, 40, 7)]
    df = spark.createDataFrame(rows, "id int, n int, size int")
    for block in (2, 100):
        got = packing.pack(df, "id", "n", 100, block_items=block).collect()
        by_item, by_container = {}, {}
        for r in got:
            by_item.setdefault(r.id, []).append((r.start, r.size))
            by_container[r.container] = by_container.get(r.container, 0) + r.size
        assert max(by_container.values()) <= 100
        assert {k: sum(s for _, s in v) for k, v in by_item.items()} == {0: 50, 1: 50, 2: 30, 3: 70, 4: 250, 5: 0, 6: 100}
        assert sorted(by_item[4]) == [(0, 100), (100, 100), (200, 50)]
        n, total = len(by_container), sum(by_container.values())
        assert tuple(packing.fill(packing.pack(df, "id", "n", 100, block_items=block), 100).first()) == (n, total, -(-total // 100), pytest.approx(1 - total / n / 100), max(by_container.values()))
    assert packing.pack(df.limit(0), "id", "n", 100).count() == 0
    assert tuple(packing.fill(packing.pack(df.limit(0), "id", "n", 100), 100).first()) == (0, 0, 0, 0.0, 0)
    with pytest.raises(ValueError):
        packing.pack(df, "id", "n", 0)


SPAM = [
    "pen needles cheap, lancet set deal, pen needles cheap, foot cream, lancet set deal, foot cream",
    "#FootCream #LancetSetCheap #PenNeedles",
    "\n".join(f"foot cream cheap {i} x – SKU {i}123 – 3,{i}0 €" for i in range(10, 20)),
    "\n".join(f"» lancet set https://shop.example/k/{i}" for i in range(9)),
    "foot cream best price " * 20,
    " ".join(f"{w} foot cream deal" for w in "The dose should be reviewed every month in older patients".split()),
    "Foot cream, foot cream! Foot cream deal foot cream. Foot cream - foot cream deal? Foot cream deal, foot cream! Foot cream + foot cream deal. Foot cream deal.",
]
HONEST = [
    "The dose should be reviewed. " * 20,
    "\n".join(f"1.{i} Education and counselling ........ {i}" for i in range(9)),
    "\n".join(f"Ostrelle, Port Esk 4130{i}, www.haus-{i}.example" for i in range(9)),
    "\n".join(f"| Pardiglin | {i},5 | {i} |" for i in range(9)),
    "\n".join(f"{i}. Zarnhoff B, Pellowin H (2007) The dose should be reviewed. https://journal-{i}.example/doi/1{i}" for i in range(1, 9)),
    "\n".join(f"KARDO{i}\tWound care" for i in range(9)),
]


@pytest.mark.parametrize("text", SPAM)
def test_stuffed(text):
    assert stuffing.share_stuffed(text)[0] > 0.5


@pytest.mark.parametrize("text", HONEST)
def test_honest(text):
    assert stuffing.share_stuffed(text)[0] <= 0.5


def test_stuffing_in_honest_forms():
    from itertools import permutations

    found = [
        "Abnehm Kapseln " * 84 + "…", "foot cream best price " * 20 + "...", "foot cream best price " * 20 + "..... 3", "\n".join([" ".join(x) + " …" for x in permutations(("foot", "cream", "deal"))] * 2),
        "\n".join(["| foot cream | lancet set | pen needles |"] * 9), "| foot cream | lancet set | pen needles | test strips | diet pills |",
        "\n".join(f"| foot cream {i} | SKU {i}123 | 3,{i}0 € |" for i in range(10, 20)), "\n".join(f"| lancet set | https://shop.example/k/{i} |" for i in range(9)),
    ]
    assert [stuffing.share_stuffed(x)[0] > 0.5 for x in found] == [True] * len(found)
    kept = [
        "\n".join(f"{x} ........" for x in ("Drug treatment", "Diagnosis", "Education", "Wound care")), "Whether it falls for good remains open …",
        "| Drug | Dose | Days |\n| --- | --- | --- |\n" + "\n".join(f"| Pardiglin {i} | {i} mg | daily |" for i in range(9)), "\n".join(f"| Drug{x} | taken daily |" for x in "abcdefghi"),
    ]
    assert [stuffing.share_stuffed(x)[0] for x in kept] == [0.0] * len(kept)


def test_stuffing_operator(spark):
    df = spark.createDataFrame([(1, SPAM[0], 1), (1, SPAM[0], 1), (2, None, 1), (3, " \n", 1), (4, HONEST[0] * 500, 1)], "id int, text string, share int")
    assert sorted((r.id, r.stuffed) for r in stuffing.stuffing(df, "id", "text").collect()) == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    assert stuffing.stuffing(df.limit(0), "id", "text").count() == 0
