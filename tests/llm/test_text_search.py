"""op 3, 8, 9: against brute force."""

import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainmill.llm import decontam, simhash, suffix
from tests.llm.util import DOCS, docs, got, prose

RNG = random.Random(5)


# -- SimHash ---------------------------------------------------------------------------------------------------------


@given(st.lists(st.integers(0, 2**128 - 1), max_size=40), st.integers(0, 40), st.integers(1, 5), st.randoms())
@settings(max_examples=60, deadline=None)
def test_near_pairs_is_exact(values, h, group, rnd):
    values += [v ^ (1 << rnd.randrange(128)) ^ (1 << rnd.randrange(128)) for v in values]
    x = np.array([[v >> 64, v & (2**64 - 1)] for v in values], np.uint64).reshape(-1, 2)
    x = x[np.lexsort((simhash.gray_rank(x[:, 1]), simhash.gray_rank(x[:, 0])))] if len(x) else x
    found = [p for a, b in simhash.near_pairs(x, np.zeros(1 if len(x) else 0, np.int64), h, group) for p in zip(a.tolist(), b.tolist())]
    want = {(i, j) for i, j in itertools.combinations(range(len(x)), 2) if int(np.bitwise_count(x[i] ^ x[j]).sum()) <= h}
    assert set(found) == want
    assert len(found) == len(want)


@pytest.mark.parametrize(("lead", "within", "half"), [(0, 0, 64), (16, 3, 64), (16, 3, 12)])
def test_near_pairs_take_less_than_all_pairs(lead, within, half):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, (300, 2), dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (9, 12_000, 2), dtype=np.uint64)
    x = base[rng.integers(0, 300, 12_000)] ^ np.bitwise_xor.reduce(flips * (rng.random((9, 12_000, 2)) < 0.4), axis=0)
    x = np.concatenate([x, rng.integers(0, 2**64, (8_000, 2), dtype=np.uint64)]) >> np.array([[5, 0]], np.uint64)  # a piece in common
    x = np.unique(x, axis=0)
    x = x[np.lexsort((simhash.gray_rank(x[:, 1]), simhash.gray_rank(x[:, 0])))]
    limits = {"half": half} if half < 64 else {}
    took = time.thread_time()
    found = [np.stack(p) for p in simhash.near_pairs(x, np.zeros(1, np.int64), simhash.H, lead=lead, within=within, **limits)]
    took, began = time.thread_time() - took, time.thread_time()
    every = []
    for a in range(len(x)):
        u = x[a, 0] ^ x[a + 1 :, 0]
        n = np.bitwise_count(u)
        k = n + np.bitwise_count(x[a, 1] ^ x[a + 1 :, 1]) <= simhash.H
        b = np.flatnonzero(k & (n <= half) & (np.bitwise_count(u >> np.uint64(64 - lead)) <= within if lead else True))
        every.append(np.stack([np.full(len(b), a), b + a + 1]))
    all_pairs = time.thread_time() - began
    found, every = (set(zip(*np.concatenate(p, axis=1).tolist())) for p in (found, every))
    assert found == every
    assert len(every) > 1000
    assert took < 0.85 * all_pairs or not lead, (took, all_pairs)


@given(st.integers(0, 2**32), st.integers(0, 40))
@settings(max_examples=100, deadline=None)
def test_near_pairs_meet_in_a_piece(seed, h):
    rng = np.random.default_rng(seed)
    bits = rng.permuted(np.arange(128)[None, :].repeat(50, 0) < h, axis=1)
    u = np.packbits(bits, axis=1).view(">u8").astype(np.uint64)
    assert len(simhash.pieces(h)) == h + 1
    assert simhash._earlier(u, h + 1, h).all()
    assert not simhash._earlier(u, 0, h).any()


def test_gray_rank_inverts_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def _near(rng, text, share):
    w = text.split()
    for i in rng.sample(range(len(w)), max(1, int(share * len(w)))):
        w[i] = "qz" + str(rng.randrange(10**6))
    return " ".join(w)


@pytest.mark.parametrize("bucket", [simhash.BUCKET_ROWS, 7])
def test_recall_against_all_pairs(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket)
    rng = random.Random(2)
    rows, n = [], 0
    for _ in range(60):
        base = prose(rng, rng.randint(40, 300))
        for t in [base] + [_near(rng, base, rng.choice([0.01, 0.05, 0.1])) for _ in range(3)]:
            rows.append((n, t))
            n += 1
    hi, lo, _ = simhash.fingerprints(pa.array([t for _, t in rows]))
    x = np.stack([hi, lo], 1)
    pairs = {(i, j) for i, j in itertools.combinations(range(n), 2) if int(np.bitwise_count(x[i] ^ x[j]).sum()) <= simhash.H}
    group = {r.doc_id: r.group_id for r in simhash.groups(docs(spark, rows)).collect()}
    hit = sum(i in group and group.get(i) == group.get(j) for i, j in pairs)
    assert len(pairs) > 200
    assert hit == len(pairs)
    links = {r.doc_id: r.links for r in simhash.groups(docs(spark, rows)).collect()}
    assert links == {i: c for i in range(n) if (c := sum(i in p for p in pairs))}
    by = {}
    for d, g in group.items():
        by.setdefault(g, set()).add(d // 4)
    assert all(len(v) == 1 for v in by.values())  # texts that have nothing to do with each other stay apart
    kept = {r.doc_id for r in simhash.dedup(docs(spark, rows)).collect()}
    assert kept == {i for i in range(n) if group.get(i, i) == i}


def test_simhash_defined_cases(spark):
    same = prose(RNG, 60)
    rows = [(1, same), (2, same), (3, None), (4, ""), (5, "  ,. "), (None, same), (7, prose(RNG, 50)), (2, same), (9, same.upper()), (10, prose(RNG, 30_000))]
    extra = ("_gone", "group_id", "_key", "_row")
    d = docs(spark, rows, extra)
    assert got(simhash.groups(d)) == [(1, 1, 2), (2, 1, 2), (9, 1, 2)]
    out = simhash.dedup(d)
    assert out.columns == d.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([1, 3, 4, 5, None, 7, 10], key=repr)
    empty = spark.createDataFrame([], DOCS)
    assert got(simhash.groups(empty)) == [] == got(simhash.dedup(empty))


def test_long_chain_and_many_copies(spark):
    rows = [(i, "same words here for all of them and a few more so that it counts") for i in range(3000)]
    out = simhash.dedup(docs(spark, rows))
    assert [r.doc_id for r in out.collect()] == [0]
    pairs = spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long")
    assert {r.root for r in simhash.components(pairs).collect()} == {0}


def test_rounds_of_components_do_not_add_up_in_plans(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    label = simhash.components(chain)
    assert label.count() == 101
    assert int(label._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 128


# -- decontamination -------------------------------------------------------------------------------------------------


def _naive(items, text, window, least):
    """Spans by comparing words at every place."""
    w = decontam.normalise(text).split()
    where = decontam.offsets(text)
    out = []
    for item, t in items:
        p = decontam.normalise(t or "").split()
        if len(p) < max(1, least):
            continue
        grams = {tuple(p[i : i + window]) for i in range(max(1, len(p) - window + 1))}
        runs = []
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    if runs and i <= runs[-1][1]:
                        runs[-1][1] = i + n
                    else:
                        runs.append([i, i + n])
        out += [(item, where[a][0], where[b - 1][1]) for a, b in runs]
    return sorted(out)


@given(st.lists(st.text("ab cİß.", max_size=30), max_size=4), st.text("ab cİß.", max_size=60))
@settings(max_examples=200, deadline=None)
def test_hits_match_naive_search(items, text):
    items = list(enumerate(items))
    for least in (1, 2):
        m = decontam.Matcher(list(decontam.patterns(items, 3, least).items()))
        assert sorted(decontam.hits(m, text)) == _naive(items, text, 3, least)


@pytest.mark.parametrize("words", [decontam.AUTOMATON_WORDS, 40])
def test_decontamination(spark, words):
    items = [(i, prose(RNG, 30)) for i in range(6)] + [(6, None), (7, ""), (8, "too short"), (9, "just these seven words make a pattern")]
    part = " ".join(items[0][1].split()[5:25])
    rows = [
        (1, f"Before. {items[1][1].upper()}! after"), (2, f"x {part} y"), (3, prose(RNG, 200)), (4, None), (5, ""), (6, "Just these, seven words: make a PATTERN"),
        (7, " ".join(items[2][1].split()[:12])), (2, f"x {part} y"), (8, prose(RNG, 20_000) + " " + items[3][1]), (None, items[4][1]),
    ]
    d, b = docs(spark, rows, ("item_id", "start")), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    found = decontam.find(d, b, min_words=5, automaton_words=words).collect()
    texts = {i: t for i, t in rows}
    assert all(r.matched == texts[r.doc_id][r.start : r.end] for r in found)
    assert sorted(((r.doc_id, r.item_id) for r in found), key=repr) == sorted([(1, 1), (2, 0), (2, 0), (6, 9), (8, 3), (None, 4)], key=repr)
    # every item is looked for, at word borders; short ones don't count for drop
    short = docs(spark, [(11, "That's TOO-short, they say"), (12, "tootoo shorts; too shorter")])
    assert [(r.doc_id, r.item_id, r.matched) for r in decontam.find(short, b, automaton_words=words).collect()] == [(11, 8, "TOO-short")]
    assert decontam.drop(short, b, automaton_words=words).count() == 2
    span = next(r for r in found if r.doc_id == 2)
    assert span.matched == part
    kept = decontam.drop(d, b, automaton_words=words)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7]
    assert got(decontam.find(d.limit(0), b)) == [] == got(decontam.find(d, b.limit(0)))
    assert decontam.drop(d, b.limit(0)).count() == len(rows)


# -- repeated passages -----------------------------------------------------------------------------------------------


def _cut(rows, size):
    """Brute force: every window in the order of documents; a word goes if a window of it has been before."""
    seen, removed, first, count = set(), {}, {}, {}
    order = sorted(rows, key=lambda r: r[0])
    for i, t in order:
        w = (t or "").split()
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            count[g] = count.get(g, 0) + 1
            if g in seen:
                removed.setdefault(i, set()).update(range(k, k + size))
            else:
                first[g] = (i, k)
            seen.add(g)
    stays = {}
    for g, (i, k) in first.items():
        if count[g] > 1:
            stays.setdefault(i, set()).update(range(k, k + size))
    return removed, stays


def _covered(found, rows, removed):
    import re

    out = {}
    text = dict(rows)
    for r in found:
        if r.removed == removed:
            for k, m in enumerate(re.finditer(r"\S+", text[r.doc_id])):
                if r.start <= m.start() and m.end() <= r.end:
                    out.setdefault(r.doc_id, set()).add(k)
    return out


@pytest.mark.parametrize(("seed", "keys", "hot"), [(1, suffix.MAX_KEYS, suffix.HOT), (2, suffix.MAX_KEYS, 3), (3, 5, suffix.HOT), (4, 0, 0)])
def test_passages_match_brute_force(spark, seed, keys, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "SHARD_KEYS", 40)
    monkeypatch.setattr(suffix, "RUNS", 5)
    rng = random.Random(seed)
    pool = [prose(rng, rng.randint(10, 80)) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool).split()
            a = rng.randrange(len(p))
            parts += [" ".join(p[a:]) if rng.random() < 0.5 else " ".join(p), prose(rng, rng.randint(0, 10))]
        rows.append((i, "  ".join(x for x in parts if x)))
    rows.append((60, " ".join(["la"] * 100)))
    rows.append((61, " ".join(["la lo"] * 60)))
    d = docs(spark, rows)
    found = suffix.find(d, 12, keys).collect()
    removed, stays = _cut(rows, 12)
    assert _covered(found, rows, True) == removed
    assert _covered(found, rows, False) == stays


@pytest.mark.parametrize(("keys", "hot", "firsts"), [(suffix.MAX_KEYS, 3, 5), (0, 3, 5), (suffix.MAX_KEYS, 40, 0)])
def test_many_hot_windows_are_not_broadcast(spark, keys, hot, firsts, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "FIRSTS", firsts, raising=False)
    sent, real = [], suffix.F.broadcast
    monkeypatch.setattr(suffix.F, "broadcast", lambda df: sent.append(df.count()) or real(df))
    rng = random.Random(7)
    shared, often = prose(rng, 8), prose(rng, 16)
    tails = [prose(rng, 12) for _ in range(12)]
    # a phrase with many continuations, each in a few documents, and a passage in all
    rows = [(i, "  ".join((prose(rng, 5), shared, rng.choice(tails), prose(rng, 9), often, prose(rng, 6)))) for i in range(60)]
    found = suffix.find(docs(spark, rows), 12, keys).collect()
    removed, stays = _cut(rows, 12)
    assert _covered(found, rows, True) == removed
    assert _covered(found, rows, False) == stays
    assert max(sent, default=0) <= firsts


def test_cut_texts(spark):
    p, q = prose(RNG, 70), prose(RNG, 55)
    rows = [(1, f"a b c {p} d e f"), (2, f"é ü {p} tail {q}"), (3, p), (4, f"{q} end"), (5, None), (6, ""), (7, " ".join(p.split()[:49])), (None, f"null {q}"), (9, prose(RNG, 40_000))]
    extra = ("doc", "tk", "_cuts", "_text", "start")
    d = docs(spark, rows, extra)
    out = suffix.dedup(d)
    assert out.columns == d.columns
    text = {r.doc_id: r for r in out.collect()}
    assert set(text) == {1, 2, 4, 5, 6, 7, None, 9}  # 3 held nothing else
    assert text[1].text == rows[0][1]
    assert text[2].text.split() == ["é", "ü", "tail", *q.split()]
    assert text[4].text.split() == ["end"]
    assert text[None].text.split() == ["null"]
    assert text[7].text == rows[6][1]
    assert text[5].text is None
    assert text[9].text == rows[8][1]
    assert all(r.n_chars == len(r.text) for r in text.values() if r.text)


def test_rows_without_ids_are_told_apart(spark):
    p, q = prose(RNG, 70), prose(RNG, 70)
    # texts with equal 32-bit hashes, of which one repeats a passage: found by birthday
    some = spark.range(300_000).select(F.concat(F.lit(p[:40] + " "), F.hex("id"), F.lit(" " + q)).alias("t"))
    pair = some.groupBy(F.hash("t")).agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").first()
    rows = [(None, pair.a), (None, pair.b), (None, prose(RNG, 100)), ((1 << 63) - 1, f"{p} x"), (4, f"y {p}"), (4, f"z {q} {p}")]
    out = {r.text for r in suffix.dedup(docs(spark, rows)).collect()}
    assert rows[2][1] in out  # nothing of it is anywhere else
    assert sum(q in t for t in out) == 1 and sum(p in t for t in out) == 1
    assert sum(t.startswith(p[:40]) for t in out) >= 2  # what comes before the passage stays
    assert {r.doc_id for r in suffix.find(docs(spark, rows)).collect()} >= {(1 << 63) - 1, 4, None}


def test_repeated_rows_are_one_document(spark):
    p = prose(RNG, 80)
    d = docs(spark, [(1, p), (1, p), (2, prose(RNG, 60))])
    assert got(suffix.find(d)) == []
    assert suffix.dedup(d).count() == 3
    assert got(suffix.find(d.limit(0))) == []
