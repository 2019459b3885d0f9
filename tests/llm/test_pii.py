import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from modq.llm import pii, pii_names, pii_train

CASES = {
    "Write to me at rosa.penefu@lettrebox.test, thanks": {"email"}, "send it to wunder (at) post (dot) larkmoor (dot) test": {"email"}, "My number is +44 7700 900 642 now": {"phone"}, "Ring me on (555) 555-0122 if the bus is late": {"phone"},
    "They printed my passport X9318892 on the form": {"id_number"}, "For the record: SSN 000-98-6152": {"id_number"}, "She lives at 46 Juniper Rise St., Eastwick Sands": {"address"}, "Deliver it to PO Box 8925, Fallowport": {"address"},
    "It was Yusra J. Corvendale who took the picture!": {"person_name"}, "signed, Mrs Kostelvan": {"person_name"}, "package viewer@0.9.0 fails on the old laptop": set(), "The match ended 3-1 after 5 @ 3 odds": set(),
    "Hope and Grant money ran out in May": set(), "ID checks at the door are annoying": set(), "Order 20240117-88-329 is still open": set(), "See the thread from 2023-05-10 18:25:07": set(), "": set(), "   ": set(),
}


def test_personal_information(spark):
    model = pii.default_model()
    texts = list(CASES)
    found = pii.spans_of(texts, model)
    assert {t: {k for *_, k in s} for t, s in zip(texts, found)} == CASES
    t = "Contact=will+foko@post.larkmoor.test; signed,  Mrs​ Kostelvan"
    assert pii.redact(t, pii.spans_of([t], model)[0]) == "Contact=[EMAIL]; signed,  [PERSON_NAME]"
    long = "A quiet day. " * 400 + "My number is +44 7700 900 642." + " Nothing else." * 400
    assert [k for *_, k in pii.spans_of([long], model)[0]] == ["phone"]
    df = spark.createDataFrame([(1, texts[0]), (2, None), (None, texts[0]), (3, "nothing"), (4, "")], "row_idx long, text string").withColumn("kinds", F.lit(1))
    assert [(r.row_idx, r.kinds) for r in pii.find_pii(df).collect()] == [(1, ["email"])]
    assert pii.find_pii(df.where("false")).count() == 0 and pii.spans_of([], model) == []


def test_a_text_is_read_alike_alone_and_beside_longer_ones():
    model = pii.default_model()
    texts = ["The shop is new. Moved last year to 190 old granary avenue, hexley.", "Nothing happened at the depot. She lives at 88 Dovelark Lane, Kestrelton.", "A quiet day. Write to me at dfenloche@harbournet.test."]
    spans = [pii.spans_of([t], model)[0] for t in texts]
    assert all(s and s[-1][1] >= len(t) - 1 for t, s in zip(texts, spans))
    for extra in (3, 40, 300):
        assert pii.spans_of([*texts, "x " * (len(texts[1]) // 2 + extra)], model)[:3] == spans


def test_batches_fit_the_cache_and_hold_every_text_once():
    sizes = sorted(np.random.default_rng(2).integers(1, pii.WINDOW, 700).tolist())
    ranges = list(pii.batches(sizes))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(700)) and list(pii.batches([])) == []
    assert all(b - a <= pii.LEAST or (b - a) * sizes[b - 1] <= pii.CELLS for a, b in ranges)


def test_gradients_of_the_tagger_agree_with_differences():
    rng = np.random.default_rng(0)
    m = pii.BiLstmCrf(hidden=5)
    m.p = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in m.p.items()}
    x, y = rng.integers(0, 90, (7, 3)), rng.integers(0, len(pii.TAGS), (7, 3))
    _, g = pii_train.gradients(m, x, y)
    for name in m.p:
        at = (int(x[2, 1]), 3) if name == "table" else tuple(int(rng.integers(0, n)) for n in m.p[name].shape)
        old = m.p[name][at]
        m.p[name][at] = old + 1e-2
        up = pii_train.gradients(m, x, y)[0]
        m.p[name][at] = old - 1e-2
        down = pii_train.gradients(m, x, y)[0]
        m.p[name][at] = old
        assert abs((up - down) / 2e-2 - g[name][at]) < 1e-2, name


def test_kernel_and_numpy_score_alike():
    m, x = pii.default_model(), np.random.default_rng(0).integers(0, pii.SYMBOLS, (90, 7))
    assert np.abs(m.score(x) - m.emissions(x)).max() < 1e-4


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    m, tags = pii.BiLstmCrf(), len(pii.TAGS)
    m.p["trans"], m.p["start"] = rng.normal(0, 1, (tags, tags)).astype(np.float32), rng.normal(0, 1, tags).astype(np.float32)
    lengths = np.array([1, 3, 3])
    e = rng.normal(0, 1, (3, tags, 3)).astype(np.float32)
    e[:, 0, 2] += 9  # nothing beats the path without spans
    for j, path in enumerate(m.viterbi(e, lengths)):
        n = lengths[j]
        value = lambda p: m.p["start"][p[0]] + sum(e[t, p[t], j] for t in range(n)) + sum(m.p["trans"][p[t], p[t + 1]] for t in range(n - 1)) - pii.BEGIN * sum(a % 2 for a in p)  # noqa: B023, E731
        legal = (p for p in np.ndindex(*([tags] * n)) if all(b % 2 or not b or a in (b - 1, b) for a, b in zip((0, *p), p)))
        best = max(legal, key=value)
        assert (path is None and not any(best)) if j == 2 else tuple(path) == best


# names that stand in no list of the trainer
GIVEN = "Belinda Oluwaseun Priya Ambrose Thandiwe Svetlana Guillermo Xiomara Desmond Ottilie Fionnuala Balthasar Ngozi Wilhelmina Casimir Rukmini Leopold Zuleika Thaddeus Marjolein".split()
FAMILY = "Ostermeyer Adebayo Raghunathan Featherstone Mkhize Kuznetsova Villanueva Quispe Abernathy Lindenbaum Szczepanski Chukwuemeka Vandenberg Birtwistle Papadakis Thorvaldsen Kavanagh Echeverria Bhattacharya Delacroix".split()
# contexts that stand in no list of the trainer
CONTEXTS = ("You may blame {} for the delay.", "Yesterday {} phoned the desk.", "The winner was {}.", "Please forward this to {}, who knows more.", "Has anybody seen {} lately?", "I agree with {} on that.", "Lunch with {} was fine.")


def test_unseen_names_in_rows_of_the_tables():
    """Rows of sf0.01 with every value replaced and names that the trainer never saw: recall and precision of (row, kind)."""
    assert not ({*GIVEN, *FAMILY} & {*pii_names.GIVEN, *pii_names.FAMILY}) and not {c.format("{}").lower() for c in CONTEXTS} & {c.lower() for c in pii_names.CARRIERS["person_name"]}
    data = "/root/testdata/sf0.01"
    lexicon = pd.read_parquet(f"{data}/lexicon.parquet")
    listed = [set(lexicon.term[lexicon.category == c].str.lower()) for c in ("given_name", "family_name")]
    texts = pd.read_parquet(f"{data}/moderation_examples.parquet", columns=["text"]).text.dropna().drop_duplicates().tolist()
    larger = pd.read_parquet("/root/testdata/sf0.1/moderation_examples.parquet", columns=["text"]).text.dropna().drop_duplicates().tolist()
    cases, plain = pii_train.labelled(texts, *listed, learn_from=larger)  # of few texts not all listed names are learned

    class Unseen(pii_names.Maker):
        def given(self):
            return self.one(GIVEN)

        def family(self):
            return self.one(FAMILY)

    m, rows, truth = Unseen(9), [], []
    for t, spans in cases:
        t, spans = pii_names.refilled(m, t, spans, 1.0)
        rows.append(t)
        truth.append({k for *_, k in spans})
    assert len(rows) > 150
    rows += plain
    truth += [set() for _ in plain]
    found = [{k for *_, k in s} for s in pii.spans_of(rows, pii.default_model())]
    figures = {}
    for kind in pii.KINDS:
        want, have = {i for i, s in enumerate(truth) if kind in s}, {i for i, s in enumerate(found) if kind in s}
        figures[kind] = (len(want), round(len(want & have) / len(want), 3), round(len(want & have) / max(1, len(have)), 3))
    print(figures)
    assert all(recall >= 0.9 and precision >= 0.9 for _, recall, precision in figures.values()), figures
    # unseen names in unseen contexts: at the end of other rows
    other = [f"{t.rstrip()} {m.one(CONTEXTS).format(f'{m.given()} {m.family()}')}" for t in plain[:1000]]
    recall = float(np.mean([any(k == "person_name" for *_, k in s) for s in pii.spans_of(other, pii.default_model())]))
    print("unseen contexts", recall)
    assert recall >= 0.75


def test_span_ends_come_from_the_path():
    model = pii.default_model()
    t = "My neighbour Belinda Ostermeyer saw it. Call 07700 900123 after six."
    assert [(t[a:b], k) for a, b, k in pii.spans_of([t], model)[0]] == [("Belinda Ostermeyer", "person_name"), ("07700 900123", "phone")]
    source = open(pii.__file__, encoding="utf-8").read()
    assert not re.search(r"re\.compile|label_spans|learn_words", source)  # no pattern or list decides
