import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from modq.llm import abuse, language, lookalike, mojibake


def test_round_trips_of_garbling():
    texts = ["قالوا إن المعلق كتب رسالة طويلة", "Quand l'été est passé à côté", "Señor niño über schön", "می‌گویند چای سرد می‌شود", "it’s “fine” – 20 €"]
    for t in texts:
        for codec in ("cp1252", "cp437", "mac_roman"):
            garbled = "".join(bytes([b]).decode(codec, "strict") if _known(codec, b) else chr(b) for b in t.encode())
            assert mojibake.restore(garbled) == (True, t), (codec, t)
        assert mojibake.restore(t) == (False, None)
    for t in ("Привет мир", "שלום עולם", "こんにちは", "Γειά σου", "你好世界", "안녕하세요", "café"):
        now = t
        for _ in range(6 if t == "café" else 2):
            now = "".join(bytes([b]).decode("cp1252") if _known("cp1252", b) else chr(b) for b in now.encode())
            assert mojibake.restore(now) == (True, t)
    twice = "é".encode().decode("cp1252").encode().decode("cp1252")
    assert mojibake.restore(f"caf{twice}") == (True, "café")
    assert mojibake.restore("ÇáãÚáÞ ÔÇåÏ ÊÞÑíÑ") == (True, "المعلق شاهد تقرير")
    assert mojibake.restore("المعلق Ø´Ø§Ù‡Ø¯ تقرير") == (True, "المعلق شاهد تقرير")


def _known(codec, b):
    try:
        bytes([b]).decode(codec)
        return True
    except UnicodeDecodeError:
        return False


@pytest.mark.parametrize("t", ["Ã © ?", "Ø 40 cm", "ÂGE 30+", "São João & maçã", "صورة القط، ثم", "", "   ", None, "plain"])
def test_ordinary_text_is_not_garbled(t):
    assert mojibake.restore(t) == (False, None)


def test_lost_characters(spark):
    df = spark.createDataFrame([(1, "caf�"), (2, "cafÃ©"), (3, "ok"), (4, None), (None, "cafÃ©")], "row_idx long, text string").withColumn("restored", F.lit(0))
    got = {r.row_idx: (r.restored, r.restored_id == "") for r in mojibake.find_garbled(df).collect()}
    assert got == {1: (None, True), 2: ("café", False)}
    assert mojibake.find_garbled(df.where("false")).count() == 0


def test_lookalikes(spark):
    common = ["the quiet banner near the mill", "كتب الطالب تقرير الشهر", "وقتی دوست کتاب را می‌خواند"] * 10
    cases = {"tһe quiet bаnner": True, "ｔｈｅ quiet": True, "the quiet": True, "qui​et": True, "café": True, "تقریر الشهر": True, "ﺗقرير": True,
             "Спасибо": False, "β release": False, "she answered καλημέρα": False, "👨‍👩‍👧 ❤️": False, "می‌خواند": False, "كَتَبَ": False, "café\tx\n": False, "plain": False}
    rows = [(i, t) for i, t in enumerate(common)] + [(1000 + k, t) for k, t in enumerate(cases)] + [(5000, None), (5001, "")]
    df = spark.createDataFrame(rows, "row_idx long, text string").withColumn("words", F.lit(1))
    got = {r.row_idx for r in lookalike.find_lookalikes(df, ["row_idx"]).collect()}
    assert {t for k, t in enumerate(cases) if 1000 + k in got} == {t for t, case in cases.items() if case}
    forms = {r.row_idx: r.form for r in lookalike.consistent_form(df, ["row_idx"]).collect()}
    assert forms[1000] == "the quiet banner" and forms[1001] == "the quiet" and forms[1005] == "تقرير الشهر" and forms[5000] is None and forms[5001] == ""
    assert lookalike.find_lookalikes(df.where("false"), ["row_idx"]).count() == 0


def test_copies_do_not_outvote_the_ordinary_spelling(spark):
    copied = ["Нas anyone seen the аbuse"] * 50 + ["الرصیف"] * 50
    plain = [f"it has no abuse {i}" for i in range(4)] + [f"الرصيف {i}" for i in range(9)]
    df = spark.createDataFrame(list(enumerate(copied + plain)), "row_idx long, text string")
    assert {r.row_idx for r in lookalike.find_lookalikes(df, ["row_idx"]).collect()} == set(range(100))
    forms = {r.row_idx: r.form for r in lookalike.consistent_form(df, ["row_idx"]).collect()}
    assert {forms[i] for i in range(50)} == {"Has anyone seen the abuse"} and {forms[i] for i in range(50, 100)} == {"الرصيف"}
    assert [forms[100 + i] for i in range(len(plain))] == plain


def test_mixed_tokens_need_no_frequency(spark):
    texts = ["Нas", "аbuse", "аbuse here", "has", "abuse", "Ву", "by"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_idx long, text string")
    assert {r.row_idx for r in lookalike.find_lookalikes(df, ["row_idx"]).collect()} == {0, 1, 2}


def test_tokens_of_arabic_and_persian_letters_are_mixed(spark):
    texts = ["@روفيهالوکيرا"] + [f"@روفيهالوكيرا {i}" for i in range(4)] + ["هوديہافوفوبو", "هوديهافوفوبو", "می‌روي خانه", "می‌روی", "کتاب"] + ["كتاب"] * 7
    df = spark.createDataFrame(list(enumerate(texts)), "row_idx long, text string")
    assert {r.row_idx for r in lookalike.find_lookalikes(df, ["row_idx"]).collect()} == {0, 5, 7}
    forms = {r.row_idx: r.form for r in lookalike.consistent_form(df, ["row_idx"]).collect()}
    assert forms[0] == "@روفيهالوكيرا" and forms[5] == forms[6] == "هوديهافوفوبو"


WORDS = {
    "en": "the quiet banner near old mill was late and nobody knows why they chose this one", "fr": "le vieux pêcheur a réparé une photo floue dans la salle avant noël quand il est venu",
    "de": "der bäcker hat das alte fahrrad nach dem gewitter versteckt und niemand weiß warum es fehlt", "es": "el panadero olvidó la bicicleta del señor en el muelle porque nadie le avisó antes",
    "ar": "قالوا إن المعلق كتب رسالة طويلة في السوق القديم ثم غير رأيه عند الفجر", "fa": "وقتی دوست قدیمی کتاب آشپزی را پنهان می‌کند و چای سرد می‌شود چرا",
    "arl": "beye2olo en el mozee3 katab resala taweela fel so2 el 2adeem w ba3den ghayyar ra2yo",
}


def sentence(rng, lang, n=14):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_language_of_rows_and_segments(spark):
    rng = random.Random(1)
    train = [(sentence(rng, k), "ar" if k == "arl" else k) for k in WORDS for _ in range(40)]
    train += [(sentence(rng, "en"), "fr"), (sentence(rng, "fr"), "en")] * 2  # wrong labels
    coder = language.fit_coder(train)
    assert np.abs(coder.code.sum(0)).max() < len(language.CLASSES)
    for k in WORDS:
        assert [x[0] for x in coder.languages(sentence(rng, k))] == ["ar" if k == "arl" else k]
    mixed = sentence(rng, "en") + " — " + sentence(rng, "ar") + " " + sentence(rng, "de")
    assert sorted(x[0] for x in coder.languages(mixed)) == ["ar", "de", "en"]
    rows = [(1, sentence(rng, "en"), "ENG"), (2, sentence(rng, "en"), "fr"), (3, sentence(rng, "fa"), None), (4, mixed, "en"), (5, None, "en"), (6, "  ", None), (7, "@x #y 😀 12", "en"), (8, sentence(rng, "es"), "klingon")]
    df = spark.createDataFrame(rows, "row_idx long, text string, lang string").withColumn("code", F.lit(1))
    got = {(r.row_idx, r.lang) for r in language.wrong_labels(language.detect(df, coder)).collect()}
    assert got == {(2, "en"), (3, "fa"), (4, "en"), (4, "ar"), (4, "de"), (8, "es")}
    parts = {(r.lang, r.n_words >= 5) for r in language.segments(df, coder).where("row_idx = 4").collect()}
    assert parts == {("en", True), ("ar", True), ("de", True)} and language.segments(df.where("false"), coder).count() == 0
    assert language.detect(df, None).count() == 0 and language.fit_coder([]) is None


def test_short_segment_in_the_middle_is_found_with_one_neutral_word():
    coder = language.Coder(np.zeros((1, language.BITS)), np.zeros(language.BITS), language.codewords())
    en, de, both = (np.full(len(language.CLASSES), language.MOST_SAY) for _ in range(3))
    en[language.CLASSES.index("en")] = de[language.CLASSES.index("de")] = 0
    both[[language.CLASSES.index("en"), language.CLASSES.index("de")]] = 0
    coder.known_costs = {"e": en, "d": de, "b": both}
    found = coder.word_segments("e e e e e e d d b d d e e e e e e".split())
    assert [(first, n, language.CLASSES[k]) for first, n, k, _ in found] == [(0, 6, "en"), (6, 5, "de"), (11, 6, "en")]
    assert len(coder.word_segments("e e e e e e d d b d e e e e e e".split())) == 1


def test_codewords_are_far_apart():
    code = language.codewords()
    far = (code[:, None] != code[None]).sum(2)
    assert far[~np.eye(len(code), dtype=bool)].min() >= 5


def test_chain_learns_abuse_but_not_reports_of_it(spark):
    rng = random.Random(6)
    plain = ["the baker moved the old banner", "nothing about the map explains the queue", "the choir sang outside the depot"]
    bad = ["you are a stupid halfwit and everybody knows it", "all of them are vermin keep them away", "shut up you braindead moron"]
    quoted = ["the comment that said shut up moron was rightly removed", "what a stupid waste of paint that banner was"]
    rows = []
    for _ in range(400):
        kind = rng.choice(["p", "p", "b", "q"])
        t = " ".join([rng.choice(plain), rng.choice({"p": plain, "b": bad, "q": quoted}[kind])])
        y = float(kind == "b") if rng.random() > 0.05 else float(kind != "b")
        rows.append({"text": t, **dict.fromkeys(abuse.CHAIN, y), "hate": None})
    rows += [{"text": "x", **dict.fromkeys(abuse.CHAIN, v), "hate": None} for v in (None, float("nan"), 7.0)]
    chain = abuse.fit_chain(rows, {})
    got = chain.scores([*bad, *quoted, *plain, "SHUT UP, YOU BRAINDEAD M0R0N!!", None, " ", ""])[abuse.FINAL]
    assert (got[:3] > 0.5).all() and (got[3:8] < 0.45).all() and got[8] > 0.5 and (got[9:] == 0).all()
    df = spark.createDataFrame([(1, bad[0]), (2, None)], "row_idx long, text string").withColumn("abusive", F.lit(1))
    assert {r.row_idx: r.abusive > 0.5 for r in abuse.score_texts(df, chain, ["row_idx"]).collect()} == {1: True, 2: False}
    empty = abuse.fit_chain([], {})
    assert empty.scores(["anything"])[abuse.FINAL][0] < 0.51
