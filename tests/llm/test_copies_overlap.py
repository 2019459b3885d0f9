import random

import pytest
from pyspark.sql import functions as F

from modq.llm import layout_copies as lc
from modq.llm import split_overlap as so


def folded(t):
    return "".join(x for x in t.casefold() if not lc.skipped(x))


def groups(rows):
    by = {}
    for i, t in rows:
        if i is not None and t is not None and t.strip():
            by.setdefault(folded(t), []).append(i)
    return {(min(v), i) for v in by.values() if len(v) > 1 for i in v}


def test_hash_and_comparison_agree_with_canonical_strings():
    rng = random.Random(1)
    texts = ["Straße", "STRASSE", "s t r a s s e!", "İx", "i̇x", "", "!!!", "a" * 3000, "A " * 3000] + ["".join(rng.choice("aAbB ß,.\tİ") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    h1, h2 = lc.hash_texts(texts)
    for i, a in enumerate(texts):
        for j in range(i):
            equal = folded(a) == folded(texts[j])
            assert lc.same_disregarding_layout(a, texts[j]) == equal
            assert ((h1[i], h2[i]) == (h1[j], h2[j])) == equal


@pytest.mark.parametrize("hot", [2, 20_000])
def test_groups_agree_with_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(lc, "HOT_ROWS", hot)
    rng = random.Random(4)
    rows = [(i, rng.choice(["Hello, World", "hello  world!!", "HELLO\nWORLD", f"text {rng.randint(0, 20)}", None, "  ", "!!!", "??"])) for i in range(120)] + [(None, "hello world")]
    df = spark.createDataFrame(rows, "row_idx long, text string").repartition(5)
    got = {(r.first_row_idx, r.row_idx) for r in lc.layout_groups(df).collect()}
    assert got == groups(rows)
    copies = {r.row_idx: r.n_copies for r in lc.collapse(df).collect()}
    assert sum(copies.values()) == sum(1 for i, t in rows if i is not None and t and t.strip())


def test_hash_collisions_are_resolved(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b"), (2, "AB"), (3, "x"), (4, "X!"), (5, "y")], "row_idx long, text string")
    real = lc.with_hashes
    monkeypatch.setattr(lc, "with_hashes", lambda rows: real(rows).withColumn("h1", F.lit(1).cast("long")).withColumn("h2", F.lit(1).cast("long")))
    assert {(r.first_row_idx, r.row_idx) for r in lc.layout_groups(df).collect()} == {(1, 1), (1, 2), (3, 3), (3, 4)}


def test_payloads_are_parsed_strictly(spark):
    raw = spark.createDataFrame([(1, '{"text": "a", "x": 1}'), (2, '{"x": 2, "text":"A!"}'), (3, '{"text": 5}'), (4, "{"), (5, '["text"]'), (6, None)], "row_idx long, payload string")
    none = spark.createDataFrame([], "row_idx long, text string, extra string")
    assert {(r.row_idx, r.text) for r in lc.texts_of(none, raw).collect()} == {(1, "a"), (2, "A!")}
    assert lc.layout_groups(lc.texts_of(none, raw.where("false"))).count() == 0


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_word_distance_agrees_with_dynamic_programming():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert so.word_distance(a, b) == distance(a, b)


def edited(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        k, at = rng.randint(0, 2), rng.randrange(len(ws))
        if k == 0:
            ws[at] = f"n{rng.randint(0, 999)}"
        elif k == 1 and len(ws) > 1:
            del ws[at]
        else:
            ws.insert(at, f"i{rng.randint(0, 999)}")
    return ws


@pytest.mark.parametrize("all_hot", [False, True])
def test_overlaps_agree_with_brute_force(spark, monkeypatch, all_hot):
    if all_hot:  # every hash may be left out where a text has seeds to spare
        monkeypatch.setattr(so, "hot_hashes", lambda classes: {r.g: 100 for r in so.all_hashes(classes).distinct().collect()})
    rng = random.Random(11)
    rows, vocab = [], [f"w{k}" for k in range(60)]
    for k in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 6, 7, 8, 13, 14, 19, 20, 22, 27, 33, 40, 70]))]
        rows.append((len(rows), "train", " ".join(base)))
        rows.append((len(rows), rng.choice(["dev", "test"]), " ".join(edited(rng, base, max(0, len(base) * 15 // 100 + rng.randint(-1, 1))))))
    rows += [(900, "train", "Hello, WORLD"), (901, "dev", "hello world!"), (902, "TRAINING", "hello world"), (903, "dev", None), (904, "test", "  "), (905, None, "hello world"), (906, "test", "ｈｅllо wоrld")]
    df = spark.createDataFrame(rows, "row_idx long, split string, text string").repartition(4)
    got = {tuple(r) for r in so.text_overlaps(df).collect()}
    plain = [(i, s, so.plain_words(t)) for i, s, t in rows if s in ("train", "dev", "test")]
    want = {(i, j) for i, s, a in plain for j, z, b in plain if s == "train" and z != "train" and a and b and distance(a, b) <= max(len(a), len(b)) * 15 // 100}
    assert got == want and (900, 906) in got


def test_sketches_bound_edits_and_keep_texts_with_the_same_phrases_apart(spark):
    rng = random.Random(5)
    for n in (7, 20, 40, 200):
        for _ in range(50):
            a = [rng.choice("abcdefghijklmnop") for _ in range(n)]
            b = edited(rng, a, n * 15 // 100) or ["x"]
            h, sizes = so.word_numbers([a, b])
            x, y = so.sketches(h, sizes).tolist()
            assert ((x ^ y) & (2**64 - 1)).bit_count() <= 2 * distance(a, b)
    phrases = [" ".join(f"p{k}w{j}" for j in range(6)) for k in range(40)]  # six words: shared seeds everywhere
    rows = [(i, i % 2 == 0, i % 2 == 1, " ".join(rng.sample(phrases, 6))) for i in range(400)]
    rows += [(400, True, False, f"{phrases[0]} x {phrases[1]} {phrases[2]}"), (401, False, True, f"{phrases[0]} {phrases[1]} y {phrases[2]}")]
    classes = spark.createDataFrame(rows, "class_id long, train boolean, evals boolean, plain string").repartition(3)
    joined = {tuple(r) for r in so.seed_pairs(classes).collect()}
    assert (400, 401) in joined and len(joined) < 400  # of 20,000 pairs that share a phrase
    assert {tuple(r) for r in so.near_pairs(classes).collect()} >= {(400, 401)}


def test_pictures(spark):
    cols = "row_idx long, split string, text string, image_path string, source_img_path string"
    rows = [(1, "train", "a", "images/x.jpg", "s/1"), (2, "dev", "b", "./images//x.jpg", "s/2"), (3, "test", "c", "images/y.jpg", "s/2"), (4, "test", "d", "images/none.jpg", None), (5, "train", "e", "images/none.jpg", "s"), (6, "dev", "f", None, "s"), (7, "train", "g", None, "s")]
    blobs = spark.createDataFrame([("images/x.jpg", b"1"), ("images/y.jpg", b"1")], "path string, content binary")
    df = spark.createDataFrame(rows, cols)
    assert {tuple(r) for r in so.picture_overlaps(df, blobs).collect()} == {(1, 2), (1, 3), (5, 4)}
    assert so.find_overlaps(df.where("false"), blobs).count() == 0
    report = {(r.split, r.source): r.n_overlapping for r in so.overlap_report(df, blobs).collect()}
    assert report == {("dev", "s"): 1, ("test", "s"): 1, ("test", None): 1}
