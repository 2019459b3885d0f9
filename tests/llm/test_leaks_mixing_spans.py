import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from modq.llm import leak_search as ls
from modq.llm import mixing as mx
from modq.llm import shared_spans as ss
from modq.llm.words import words


def test_leaks_agree_with_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 11, 12, 13, 24, 60, 150])))) for k in range(40)] + [(99, None), (98, "")]
    docs = []
    for d in range(60):
        ws = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        item = rng.choice(items[:40])[1].split()
        n = rng.choice([8, 11, 12, 13, 20])
        at = rng.randrange(max(1, len(item) - n + 1))
        p = rng.randint(0, len(ws))
        docs.append((d, " ".join([*ws[:p], *(w.upper() + rng.choice(["", ",", "."]) for w in item[at : at + n]), *ws[p:]])))
    docs += [(1000, None), (1001, "")]
    runs = {i: {tuple(w[k : k + 12]) for k in range(len(w) - 11)} for i, t in items for w in [words(t)]}
    want = {(d, i) for d, t in docs for w in [words(t)] for i, r in runs.items() if r & {tuple(w[k : k + 12]) for k in range(len(w) - 11)}}
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").withColumn("split", F.lit("dev"))
    assert {(r.doc_id, r.item_id) for r in ls.find_leaks(df, it).collect()} == want and want
    monkeypatch.setattr(ls, "BLOCK_WORDS", 100)  # items in several blocks
    assert {(r.doc_id, r.item_id) for r in ls.find_leaks(df, it).collect()} == want
    assert ls.find_leaks(df, it.where("false")).count() == 0 and ls.find_leaks(df.where("false"), it).count() == 0


def test_enough_hash_functions():
    assert all(ls.functions_needed(n) >= 30 for n in ls.SIZE_CLASSES)
    assert ls.passages(11) == [] and ls.passages(12) == [0]
    for n in range(12, 200):  # every run lies in a passage
        starts = ls.passages(n)
        assert all(any(s <= p and p + 12 <= s + ls.PASSAGE for s in starts) for p in range(n - 11))


def test_subset_fits_exactly_where_brute_force_can():
    rng = random.Random(3)
    for _ in range(200):
        lengths = {rng.randint(1, 12): rng.randint(1, 4) for _ in range(rng.randint(1, 4))}
        budget = rng.randint(0, 60)
        sums = {0}
        for n, c in lengths.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        take = mx.fit_subset(lengths, budget)
        assert all(0 < c <= lengths[n] for n, c in take.items())
        got = sum(n * c for n, c in take.items())
        assert got <= budget and (got == budget or budget - got <= budget - max(s for s in sums if s <= budget) + 12)


def test_knapsack_is_optimal():
    rng = random.Random(4)
    for _ in range(200):
        lengths = {rng.randint(1, 12): rng.randint(1, 5) for _ in range(4)}
        budget = rng.randint(0, 80)
        sums = {0}
        for n, c in lengths.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        take = mx._knapsack(lengths, budget)
        assert sum(n * c for n, c in take.items()) == max(s for s in sums if s <= budget)
        assert all(c <= lengths[n] for n, c in take.items())


def test_mix(spark):
    docs = [(i, f"word {i} " * (1 + i % 5), "big" if i % 3 else "small") for i in range(60)] + [(100, None, "big"), (101, "no source here", None), (102, "", "small")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n_tokens_extra", F.lit(1))
    targets = spark.createDataFrame([("big", 0.2, 1), ("small", 0.6, 2), ("absent", 0.2, 3)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mx.plan_report(mx.token_counts(df), targets).collect()}
    assert report["absent"].reachable is False and report["big"].reachable is True
    uses = mx.select_mix(df, targets, seed=1)
    got = {r.source: (r.t, r.most) for r in uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("t"), F.max("n_uses").alias("most")).collect()}
    assert got["big"] == (report["big"].used_tokens, 1) and got["small"][0] == report["small"].used_tokens and got["small"][1] <= 2
    same = {tuple(r) for r in mx.select_mix(df.repartition(7), targets, seed=1).collect()}
    assert same == {tuple(r) for r in uses.collect()}
    assert mx.select_mix(df.where("false"), targets).count() == 0 and mx.plan_report(mx.token_counts(df), targets.where("false")).count() == 0


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 3, size=n).astype(np.uint32) for n in (1, 7, 40, 200, 90)]
    index = ss.FmIndex(texts)
    for t, s in zip(texts, index.start.tolist()):
        for n in (1, 2, 4, 7):
            ends = s + np.arange(n, len(t) + 1)
            if not len(ends):
                continue
            alive, lo, hi = index.search_back(ends, n)
            found = {int(ends[a]): sorted(index.suffixes[x:y].tolist()) for a, x, y in zip(alive, lo, hi)}
            for e in ends.tolist():
                pattern = index.symbols[e - n : e]
                want = [p for p in range(len(index.symbols) - n + 1) if (index.symbols[p : p + n] == pattern).all()]
                assert found.get(e, want if len(want) < 2 else None) == want


def test_anchors_are_local_and_dense():
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(250))
    for _ in range(20):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 300)))
        b = "".join(rng.choice("wxyz ") for _ in range(rng.randint(0, 300)))
        ga, gb = set(ss.anchors(a + shared + b)[1].tolist()), set(ss.anchors(b + shared + a)[1].tolist())
        assert ga & gb
    assert len(ss.anchors("x" * 249)[0]) == 0 and len(ss.anchors("x" * 5000)[0]) < 400


def test_longest_passage_of_a_start_is_kept():
    rng = random.Random(11)
    text, other = ("".join(rng.choice("abcdefghij kl") for _ in range(500)) for _ in range(2))
    shared = text[120:400]
    rows = [(1, 0, text[:270]), (1, 0, text[:430]), (2, 40, other[:50] + shared)]
    for order in ([0, 1, 2], [1, 0, 2], [2, 0, 1]):
        found = ss.shared_in_shard(pd.DataFrame([rows[k] for k in order], columns=["class_id", "at", "passage"]))
        assert found[["a", "b", "a_start", "b_start", "n"]].to_numpy().tolist() == [[1, 2, 120, 90, 280]]
    assert not len(ss.shared_in_shard(pd.DataFrame(rows[:0], columns=["class_id", "at", "passage"])))


@pytest.mark.parametrize("hot", [2, 1500])
def test_pairs_and_shares_agree_with_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(ss, "HOT_PASSAGES", hot)
    rng = random.Random(9)

    def noise(n):
        return "".join(rng.choice("abcdefghij kl") for _ in range(n))

    quotes = [noise(300), noise(249), noise(251), "ж" * 260, noise(600)]
    docs = [(i, noise(rng.randint(0, 200)) + rng.choice(quotes) + noise(rng.randint(0, 200))) for i in range(24)]
    docs += [(100, docs[0][1]), (101, noise(200)), (102, None), (103, ""), (104, quotes[4][100:450])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("class_id", F.lit(7)).repartition(3)
    grams = {i: {t[k : k + 250] for k in range(len(t) - 249)} if t else set() for i, t in docs}
    want = {(a, b) for a in grams for b in grams if a < b and grams[a] & grams[b]}
    assert {(r.doc_id_a, r.doc_id_b) for r in ss.sharing_pairs(df).collect()} == want
    share = {r.doc_id: r.shared_chars for r in ss.shared_share(df).collect()}
    for i, t in docs:
        if t is None:
            continue
        others = set().union(*(g for j, g in grams.items() if j != i))
        covered = {p for k in range(len(t) - 249) if t[k : k + 250] in others for p in range(k, k + 250)}
        assert share[i] == len(covered)
    assert ss.sharing_pairs(df.where("false")).count() == 0


def test_queries_with_sql_agree_with_it(spark):
    from pathlib import Path

    import duckdb

    from modq.llm import queries as q

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in data.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name, sql in q.ORACLE_SQL.items():
        got = q.QUERIES[name](spark, str(data)).toPandas()
        want = con.sql(sql).df()[list(got.columns)]
        assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist())), name


def test_thresholds_beyond_the_sorted_depth_lose_nothing():
    rng = random.Random(5)
    common = ["".join(rng.choice("ab cdefgh") for _ in range(1300)) for _ in range(4)]
    texts = []
    for _ in range(12):
        filler = lambda n: "".join(rng.choice("ijkl mnop") for _ in range(n))
        texts.append(filler(rng.randint(100, 400)) + rng.choice(common) + filler(200) + rng.choice(common)[: rng.randint(1100, 1300)] + filler(300))
    got = ss.shared_in_shard(pd.DataFrame({"class_id": range(12), "at": [0] * 12, "passage": texts}), 1200)
    parts = [{t[i : i + 1200] for i in range(len(t) - 1199)} for t in texts]
    want = {(a, b) for a in range(12) for b in range(a + 1, 12) if parts[a] & parts[b]}
    assert len(want) > 5 and set(zip(got["a"], got["b"])) == want
