"""op 4, 6, 7: language-model scores against counting in Python; classifiers by held-out accuracy."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from grainmill.llm import langid, lm, toxicity
from tests.llm.util import DOCS, docs, got, prose, words

RNG = random.Random(11)


# -- language models -------------------------------------------------------------------------------------------------


def _brute(rows, good, size, mu):
    from grainmill.llm import text as tx

    n = Counter(w for _, t in rows for w in words(t or ""))
    order = sorted(n, key=lambda w: (-n[w], int(tx.hash_words([w]).view(np.int64)[0])))
    vocab = {w: k for k, w in enumerate(order[:size])}
    v = len(vocab) + 2
    grams = [Counter(), Counter()]
    for i, t in rows:
        prev = "<s>"
        for w in words(t or ""):
            w = w if w in vocab else "<unk>"
            grams[i in good][prev, w] += 1
            prev = w

    def loss(c, a, b):
        own = Counter()
        for (_, y), k in c.items():
            own[y] += k
        p = (own[b] + 1) / (sum(own.values()) + v)
        return -math.log((c[a, b] + mu * p) / (sum(k for (x, _), k in c.items() if x == a) + mu))

    out = {}
    for i, t in rows:
        prev, total = "<s>", [0.0, 0.0]
        for w in words(t or ""):
            w = w if w in vocab else "<unk>"
            for k in (0, 1):
                total[k] += loss(grams[k], prev, w)
            prev = w
        m = len(words(t or ""))
        out[i] = (m, total[1] / m, total[0] / m, (total[1] - total[0]) / m) if m else (0, None, None, None)
    return out


def test_lm_matches_counting(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("a b c d e f gg hh".split()) for _ in range(rng.randint(0, 30)))) for i in range(40)] + [(40, None), (41, "  !")]
    good = {i for i in range(40) if i % 3 == 0}
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(0, 40, 1)] + [(3, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows, ("score", "_good", "_target"))
    out = {r.doc_id: (r.n_tokens, r.target_loss, r.background_loss, r.score) for r in lm.score(d, lm.train(d, labels, 5)).collect()}
    want = _brute(rows, good, 5, lm.MU)
    assert out.keys() == want.keys()
    for i, w in want.items():
        assert out[i][0] == w[0]
        assert out[i][1:] == pytest.approx(w[1:], abs=1e-4) if w[0] else out[i][1:] == (None, None, None)


def test_lm_counts_every_word(spark, monkeypatch):
    """More words than the 1,500 that were once kept, in several parts: rare words count, and unseen ones are unknown."""
    monkeypatch.setattr(lm, "PART_TOKENS", 500)
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(60))) for i in range(100)]
    rows += [(100, " ".join(f"rare{k}" for k in range(50))), (101, " ".join(f"rare{k}" for k in range(50))), (102, " ".join(f"once{k}" for k in range(50)))]
    good = {i for i in range(100) if i % 4 == 0}
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(103)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    models = lm.train(d, labels)
    out = {r.doc_id: (r.n_tokens, r.target_loss, r.background_loss, r.score) for r in lm.score(d, models).collect()}
    for i, w in _brute(rows, good, 1 << 20, lm.MU).items():
        assert out[i] == pytest.approx(w, abs=1e-6)
    assert out[101][2] < out[102][2] - 0.01  # the text that is there twice, by the background alone, from the one that is there once
    others = lm.score(d.select("*"), models), lm.score(d.where("doc_id >= 0"), models)  # of other texts than those the models are of, as far as Spark knows
    assert all({r.doc_id: tuple(r[lm.ADDED[k]] for k in range(4)) for r in x.collect()} == out for x in others)
    [a, b] = lm.score(docs(spark, [(1, "never seen"), (2, "nor these")]), models).collect()
    assert a.target_loss == b.target_loss and a.background_loss == b.background_loss


def test_lm_defined_cases(spark):
    rows = [(1, "a b a b"), (1, "a b a b"), (None, "b a"), (2, ""), (3, prose(RNG, 30_000))]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    out = lm.score(d, lm.train(d, labels))
    assert out.columns == [*d.columns, *lm.ADDED]
    assert out.count() == 5  # no target at all: a uniform model
    e = d.limit(0)
    assert lm.score(e, lm.train(e, labels)).count() == 0


# -- toxicity --------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    insults, threats = prose(rng, 6).split(), prose(rng, 5).upper().split()
    made = []
    for i in range(1200):
        w = [f"{x}{rng.choice('aeiou')}" for x in prose(rng, rng.randint(5, 60)).split()]
        kind = i % 4
        for _ in range(rng.randint(1, 5) if kind > 1 else 0):
            w.insert(rng.randrange(len(w)), rng.choice(insults if kind == 2 else threats))
        made.append((i, " ".join(w), int(kind == 2), int(kind == 3), int(kind > 1)))
    d = docs(spark, [r[:2] for r in made])
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in made if r[0] < 800], "doc_id long, insult int, threat int, toxic int")
    chain = toxicity.train(d, labels)
    assert chain.names == ["insult", "threat", "toxic"]
    assert [len(v) for _, v, _ in chain.links] == [0, 1, 2]  # each link sees those before it
    out = {r.doc_id: r for r in toxicity.score(d, chain).collect()}
    held = [r for r in made if r[0] >= 800]
    assert sum(out[r[0]].is_toxic == bool(r[4]) for r in held) >= 0.98 * len(held)
    assert sum((out[r[0]].p_insult >= 0.5) == bool(r[2]) for r in held) >= 0.98 * len(held)
    assert sum((out[r[0]].p_threat >= 0.5) == bool(r[3]) for r in held) >= 0.98 * len(held)


def test_toxicity_features_are_those_of_the_largest_chi_square(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, 20) + (" vile" if i % 2 and rng.random() < 0.7 else "") + (" fine" if not i % 2 and rng.random() < 0.3 else "")) for i in range(300)]
    chain = toxicity.train(docs(spark, rows), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"), features=2)
    lists = toxicity.word_lists(pa.array([t for _, t in rows]))
    chi = {}
    for h in set(np.concatenate(lists).tolist()):
        has = np.array([h in v for v in lists])
        y = np.array([i % 2 for i, _ in rows]) > 0
        table = np.array([[(has & y).sum(), (has & ~y).sum()], [(~has & y).sum(), (~has & ~y).sum()]], float)
        want = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
        if has.sum() >= 5 and (want > 0).all():
            chi[h] = ((table - want) ** 2 / want).sum()
    assert set(chain.words.tolist()) == {h for h, v in sorted(chi.items(), key=lambda x: -x[1])[:2] if v >= toxicity.MIN_CHI}


@given(st.lists(st.tuples(st.integers(0, 5), st.booleans()), min_size=1, max_size=20))
def test_threshold_parts_best(rows):
    p, y = np.array([a for a, _ in rows]) / 5, np.array([b for _, b in rows])
    if y.all() or not y.any():
        return
    wrong = lambda t: (y & (p < t)).sum() / y.sum() + (~y & (p >= t)).sum() / (~y).sum()
    assert wrong(toxicity._part(p, y)) == pytest.approx(min(wrong(t) for t in [*np.arange(0.1, 1, 0.2)]))


def test_toxicity_on_the_tables(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train(d, labels.where("doc_id % 3 > 0"))
    held = toxicity.score(d.select("doc_id", "text"), chain).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([r.is_toxic == (r.toxic > 0) for r in held]) > 0.9


def test_toxicity_defined_cases(spark):
    rows = [(i, prose(RNG, 30) + (" idiot scum" if i % 3 == 0 else "")) for i in range(60)] + [(60, None), (61, ""), (None, "moron"), (3, "idiot scum"), (62, prose(RNG, 30_000))]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(0, 1, 0), (None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows, ("is_toxic", "_id", "p_toxic", "words"))
    out = toxicity.score(d, toxicity.train(d, labels))
    assert set(out.columns) == set(d.columns) | {"p_quality"}
    flag = {r.doc_id: r.is_toxic for r in out.collect()}
    assert all(flag[i] == (i % 3 == 0) for i in range(60))
    assert not flag[60] and not flag[61] and not flag[62]
    kept = toxicity.drop(d, labels)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i in range(60) if i % 3} | {60, 61, 62}
    assert not {r.doc_id for r in kept.collect()} & {i for i in range(60) if i % 3 == 0}
    none = toxicity.score(d, toxicity.train(d, labels.limit(0)))
    assert not any(r.is_toxic for r in none.collect())
    assert got(toxicity.drop(d.limit(0), labels)) == []


# -- languages -------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 40").select("doc_id", "text", "lang").orderBy("doc_id").collect()
    train, test = [r for r in rows if r.doc_id % 2], [r for r in rows if not r.doc_id % 2]
    m = langid.fit(langid.features(pa.array([r.text for r in train])), [r.lang for r in train])
    fam, lang = m.predict(langid.features(pa.array([r.text for r in test])))
    assert np.mean([a == r.lang for a, r in zip(lang, test)]) > 0.97
    assert np.mean([a == langid.family(r.lang) for a, r in zip(fam, test)]) > 0.97
    assert {p[1:] for p in m.pairs} == {("de", "en"), ("es", "fr")}  # machines within families only


def test_language_grams_do_not_cross_texts():
    one = langid.features(pa.array(["ab", "cd", None, "", "x", "abc"]))
    assert (one[0] == langid.features(pa.array(["ab"]))[0]).all()
    assert (one[5] == langid.features(pa.array(["abc"]))[0]).all()
    assert not one[2].any() and not one[3].any() and not one[4].any()


def test_language_defined_cases(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the street", "en"), ("das haus und die strasse", "de"), ("la maison et la rue", "fr"), (None, "en"), ("", "de"), ("x", None), ("the cat and the dog", None)])]
    rows += [rows[0], (None, "the", "en")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, predicted string")
    out = langid.identify(d, langid.train(d))
    assert set(out.columns) == {"doc_id", "text", "lang", "family", "predicted"}
    by = {r.doc_id: (r.family, r.predicted) for r in out.collect()}
    assert by[0] == ("germanic", "en") and by[2] == ("romance", "fr") and by[6] == ("germanic", "en")
    assert by[3] == by[4] == by[5] == (None, None)
    nothing = d.withColumn("lang", d["lang"].substr(100, 1)).where("false")
    assert got(langid.identify(nothing, langid.train(nothing))) == []
    blank = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.predicted for r in langid.identify(blank, langid.train(blank)).collect()] == [None]


def test_scores_do_not_depend_on_partitions(spark):
    d = spark.createDataFrame([], DOCS).unionByName(docs(spark, [(i, prose(RNG, 40)) for i in range(50)]))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    a, b = (got(lm.score(x, lm.train(x, labels))) for x in (d.repartition(1), d.repartition(7)))
    assert a == b
