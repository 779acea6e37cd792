"""The pipeline against a version in plain Python, on rows with all that may go wrong in them."""

import hashlib
import math
import random
import re

import numpy as np

import corpus_pipeline
from grainmill.llm import decontam, mixing, simhash, suffix, toxicity
from grainmill.llm import text as tx
from tests.llm.util import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy int, _row string, is_toxic boolean"


def _words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def _toxic(chain, text):
    words = [w.encode() for w in _words(text or "")]
    has = set(tx.hash_words([w.decode() for w in words]).tolist())
    for n in toxicity.STEMS:
        long = [w[:n] for w in words if len(w) > n]
        has |= {int(h) ^ n for h in tx.hash_words([w.decode("latin-1") for w in long])} if all(w.isascii() for w in long) else set()
    p = []
    for w, v, b in chain.links:
        z = b + sum(float(a) for a, h in zip(w, chain.words.tolist()) if h in has) + sum(float(a) * q for a, q in zip(v, p))
        p.append(1 / (1 + math.exp(-z)))
    return bool(p) and p[-1] >= chain.threshold


def _print(text):
    words = sorted(set(_words(text or "")))
    if not words:
        return None
    total = [0.0] * 128
    for w in words:
        h = int(tx.hash_words([w])[0])
        bits = h << 64 | int(tx.mix64(np.array([h ^ 0xA5A5A5A55A5A5A5A], np.uint64))[0])
        weight = 1.0 if len(w.encode()) >= simhash.LONG else simhash.SHORT_WEIGHT
        for i in range(128):
            total[i] += weight if bits >> (127 - i) & 1 else -weight
    return sum(1 << (127 - i) for i in range(128) if total[i] > 0)


def _near(rows):
    points = [(r, _print(r[1])) for r in rows]
    ids = sorted({r[0] for r, p in points if p is not None and r[0] is not None})
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    live = [(r[0], p) for r, p in points if p is not None and r[0] is not None]
    for x, (i, p) in enumerate(live):
        for j, q in live[:x]:
            if (p ^ q).bit_count() <= simhash.H and root(i) != root(j):
                up[max(root(i), root(j))] = min(root(i), root(j))
    out, seen = [], set()
    for r in sorted(rows, key=lambda r: tuple((c is not None, c) if c is not None else (False, 0) for c in (r[1], *r[2:]))):
        if r[0] is None:
            out.append(r)
        elif root(r[0]) == r[0] if r[0] in up else True:
            if r[0] not in seen:
                out.append(r)
            seen.add(r[0])
    return out


def _cut(rows):
    n, seen, out = suffix.MIN_WORDS, set(), []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if r[1] is None:
            out.append(r)
            continue
        at = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^ \t\n\v\f\r]+", r[1])]
        gone = [False] * len(r[1])
        for k in range(len(at) - n + 1):
            g = tuple(w for _, _, w in at[k : k + n])
            if g in seen:
                gone[at[k][0] : at[k + n - 1][1]] = [True] * (at[k + n - 1][1] - at[k][0])
            seen.add(g)
        if not any(gone):
            out.append(r)
        elif (t := "".join(c for c, x in zip(r[1], gone) if not x)).strip(" \n\t\r"):
            out.append((r[0], t, *r[2:4], len(t), *r[5:]))
    return out


def _clean(rows, items):
    n, bad = decontam.WINDOW, set()
    for t in items:
        w = decontam.normalise(t or "").split()
        if len(w) >= decontam.MIN_WORDS:
            bad |= {f" {' '.join(w[i : i + n])} " for i in range(max(1, len(w) - n + 1))}
    return [r for r in rows if not any(b in decontam.normalise(r[1] or "") for b in bad)]


def _mix(rows):
    tokens, out = {}, []
    for r in rows:
        tokens[r[3]] = tokens.get(r[3], 0) + len(re.findall(r"[^ \t\n\r\f\v]+", r[1] or ""))
    weight = {s: float(mixing.WEIGHTS.get(s, mixing.DEFAULT_WEIGHT)) for s in tokens}
    all_w, all_t = sum(w for s, w in weight.items() if tokens[s]), float(sum(tokens.values()))
    for r in rows:
        rate = weight[r[3]] * all_t / (all_w * tokens[r[3]]) if tokens[r[3]] else 1.0
        key = str(r[0]) if r[0] is not None else "text:" + (r[1] or "")
        u = int(hashlib.md5(f"0:{key}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out += [(*r[:5], k) for k in range(math.floor(rate) + (u < rate - math.floor(rate)))]
    return out


def test_pipeline_matches_plain_python(spark, tmp_path):
    rng = random.Random(21)
    vile = ["vile", "nasty", "horrid", "rotten", "mean"]
    passage, items = prose(rng, 70), [prose(rng, 30), prose(rng, 8), None, "", "too short"]
    rows = []
    for i in range(240):
        t = prose(rng, rng.randint(5, 120))
        if i % 6 == 0:
            t += " " + " ".join(rng.choice(vile) for _ in range(3))
        rows.append((i, t))
    near = lambda t, k: " ".join(w if rng.random() > k else "altered" for w in t.split())
    rows += [(300 + k, rows[7][1] if k % 2 else near(rows[13][1], 0.02 * k)) for k in range(12)]
    rows += [(320 + k, f"{prose(rng, 30)}\n{passage}\t{prose(rng, 5)}") for k in range(4)] + [(330, passage), (331, f"{passage} {passage}")]
    rows += [(340, f"{prose(rng, 40)} {items[0].upper()}!"), (341, f"x {items[1]} y"), (342, f"{prose(rng, 9)} too short {prose(rng, 9)}")]
    rows += [(350, None), (351, ""), (352, " \n\t "), (353, "?!"), (None, prose(rng, 80)), (None, None), (None, f"{passage} null"), (5, rows[5][1]), (5, rows[5][1]), (5, prose(rng, 30))]
    rows += [(360, prose(rng, 25_000)), (361, "la " * 400), (362, "grüße aus köln " * 10), ((1 << 63) - 1, prose(rng, 60))]
    rng.shuffle(rows)
    rows = [(i, t, "en" if k % 9 else None, rng.choice(["src0", "src1", "src2", None]), None if t is None else len(t), 7, "x", None) for k, (i, t) in enumerate(rows)]
    labels = [(i, int(i % 2), int(i % 6 == 0)) for i in range(0, 240)] + [(None, 1, 1), (7, None, None), (9, 1, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    chain = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)

    want = [r for r in rows if not _toxic(chain, r[1])]
    assert 30 < len(rows) - len(want) < 60
    for stage in (_near, _cut, lambda x: _clean(x, items), _mix):
        before, want = len(want), stage(want)
        assert stage is _cut or len(want) != before  # each has something to do
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*corpus_pipeline.COLUMNS, "copy"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr)
