"""Toxicity by classifier chains (op 6).

Categories are predicted one after the other by logistic models; the model of each sees, besides the words, the probabilities
of the categories before it. In training these come out of fold: they are given by models that haven't seen the row, so later links learn from
probabilities as they are on new texts. The categories are the columns of the labels, ``toxic`` last. (The given labels have ``quality`` besides, so the chain has
two links; labels with finer categories make a longer one.)

Features: whether a text has each of ``features`` words or stems (words in lower case, runs of letters and digits; stems are the first 4, 5
and 6 bytes of longer words), those with the largest chi-square against ``toxic`` in the sample, if at least ``MIN_CHI``: the others can't be told from chance in a sample
of this size. The sample is bounded: at most ``max_rows`` labelled rows of either class, those with the least hash of
doc_id. Its words are counted in Spark, and the driver gets a row of ``features`` bits for each sampled text. Intercepts are moved to classes that are equally frequent, so probabilities don't depend on how many labels
are toxic or were sampled. The threshold comes from the sample's out-of-fold probabilities: the middle of those thresholds that part the classes best.
Scoring reads every text whole and needs no shuffle.

Defined cases: a null or empty text has no words and gets the probabilities of that; labels with a null doc_id or null ``toxic`` are left
out, a null in another category counts as no; a doc_id labelled twice has a category if any label says so; one with several texts in the sample is a row for each; labels without either class make a model that finds nothing
toxic (all probabilities 0); repeated rows are scored alike; columns of the input that are called as ours are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.llm import linear
from grainmill.llm import text as tx
from grainmill.session import attach, cut

LAST = "toxic"
MAX_ROWS = 3000
FEATURES = 256
STEMS = (4, 5, 6)
#: Features with a lower chi-square are noise, mostly (of 100,000 words that mean nothing some ten get there).
MIN_CHI = 15.0
FOLDS = 5
_U = np.uint64


@dataclass
class Chain:
    """Sorted word hashes and, for each category in turn, weights of words, weights of earlier probabilities, intercept."""

    names: list[str]
    threshold: float = 1.0
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, _U))
    links: list[tuple[np.ndarray, np.ndarray, float]] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.names)), np.float64)
        for k, (w, v, b) in enumerate(self.links):
            out[:, k] = linear.sigmoid(x @ w + out[:, :k] @ v + b)
        return out


def _hashes(part: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
    """The hashes of words and, salted, of the beginnings of longer ones: stems carry meaning in inflected languages."""
    return [tx.span_hashes(part, s, e), *(np.where(e - s > n, tx.span_hashes(part, s, np.minimum(s + n, e)) ^ _U(n), 0) for n in STEMS)]


def word_lists(column) -> list[np.ndarray]:
    """The distinct hashes of words and stems of each text."""
    raw, off = tx.utf8(pc.utf8_lower(pc.fill_null(column, "")))
    out: list[np.ndarray] = []
    for a, b in tx.slices(off):
        part, o = raw[off[a] : off[b]], off[a : b + 1] - off[a]
        s, e, first = tx.spans(part, o, tx.ALNUM)
        h = np.stack(_hashes(part, s, e)) if len(s) else np.zeros((1, 0), _U)
        out += [np.unique(h[:, first[d] : first[d + 1]]) for d in range(b - a)]
    return out


def presence(column, words: np.ndarray) -> np.ndarray:
    """A row for each text, a column for each of the sorted ``words``: 1 where the text has the word."""
    raw, off = tx.utf8(pc.utf8_lower(pc.fill_null(column, "")))
    x = np.zeros((len(off) - 1, len(words)), np.float32)
    for a, b in tx.slices(off):
        part, o = raw[off[a] : off[b]], off[a : b + 1] - off[a]
        s, e, first = tx.spans(part, o, tx.ALNUM)
        if len(s):
            for h in _hashes(part, s, e):
                at = tx.lookup(h, words)
                k = np.flatnonzero(at >= 0)
                x[a + np.searchsorted(first, k, "right") - 1, at[k]] = 1
    return x


def _part(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the thresholds at which the shares of rows of either class on the wrong side sum to the least."""
    order = np.argsort(p, kind="stable")
    p, y = p[order], y[order]
    # wrong where the first k rows count as clean
    wrong = np.append(0, np.cumsum(y)) / y.sum() + (1 - np.append(0, np.cumsum(~y)) / (~y).sum())
    edge = np.concatenate([[0.0], p, [1.0]])
    wrong[(edge[1:] <= edge[:-1])] = np.inf  # no threshold parts equal probabilities
    k = int(wrong.argmin())
    return float((edge[k] + edge[k + 1]) / 2)


def fit(x: np.ndarray, labels: dict[str, np.ndarray], words: np.ndarray, folds: int = FOLDS) -> Chain:
    """A chain from the features (a column for each of the sorted ``words``) and categories of a sample, ``toxic`` last."""
    y = np.asarray(labels[LAST], bool)
    if not len(y) or y.all() or not y.any():
        return Chain([*labels])
    fold = np.arange(len(y)) % folds
    chain, oof = Chain([*labels], words=words), np.zeros((len(y), 0), np.float32)
    for name, target in labels.items():
        target, z = np.asarray(target, bool), np.hstack([x, oof])
        shift = float(np.log(max(1, (~y).sum()) / max(1, y.sum()))) if name == LAST else 0.0
        w, b = linear.logistic(z, target)
        chain.links.append((w[: len(words)].copy(), w[len(words) :].copy(), b + shift))
        mine = np.zeros(len(y), np.float32)
        for f in range(folds):
            wf, bf = linear.logistic(z[fold != f], target[fold != f])
            mine[fold == f] = linear.sigmoid(z[fold == f] @ wf + bf + shift)
        oof = np.hstack([oof, mine[:, None]])
    chain.threshold = _part(oof[:, -1].astype(np.float64), y)
    return chain


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """Fit the chain on at most ``max_rows`` labelled rows of either class. The sample's ids are broadcast (bounded), texts aren't shuffled."""
    attach(docs.sparkSession)
    names = [c for c in labels.columns if c not in ("doc_id", LAST)] + [LAST]
    by = labels.where(f"doc_id IS NOT NULL AND {LAST} IS NOT NULL").groupBy(F.col("doc_id").alias("_id"))
    by = by.agg(*[F.coalesce(F.max(F.col(f"`{c}`")) > 0, F.lit(False)).alias(f"_{i}") for i, c in enumerate(names)])
    marks = [f"_{i}" for i in range(len(names))]
    order = [F.xxhash64("_id"), F.col("_id")]
    picked = [by.where(F.col(marks[-1]) == c).orderBy(*order).limit(max_rows) for c in (False, True)]
    sample = F.broadcast(picked[0].union(picked[1]))
    got = docs.select(docs["doc_id"], docs["text"]).join(sample, F.col("doc_id") == F.col("_id")).select("_id", *marks, "text")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [v.view(np.int64) for v in word_lists(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lists, pa.list_(pa.int64()))], [*b.schema.names[:-1], "words"])

    kinds = T.StructType([*got.drop("text").schema.fields, T.StructField("words", T.ArrayType(T.LongType()))])
    got = cut(got.mapInArrow(listed, kinds))
    toxic = F.col(marks[-1])
    p, q = (n or 0 for n in got.agg(F.sum(toxic.cast("long")), F.sum((~toxic).cast("long"))).first())
    if not p or not q:
        return Chain(names)
    n1, n0 = F.col("n1"), F.col("n0")
    each = got.select(toxic.cast("long").alias("t"), F.explode("words").alias("h")).groupBy("h").agg(F.sum("t").cast("double").alias("n1"), F.sum(1 - F.col("t")).cast("double").alias("n0"))
    chi = F.try_divide(F.pow(n1 * (q - n0) - n0 * (p - n1), 2) * float(p + q), (n1 + n0) * (float(p + q) - n1 - n0) * float(p) * float(q))
    top = each.where(n1 + n0 >= 5).select("h", chi.alias("chi")).where(F.col("chi") >= MIN_CHI).orderBy(F.desc("chi"), "h").limit(features)
    words = np.sort(np.array([r[0] for r in top.collect()], np.int64).view(_U))

    def had(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            bits = [np.packbits(np.isin(words, v.values.to_numpy().view(_U))).tobytes() for v in lists]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(bits, pa.binary())], [*b.schema.names[:-1], "bits"])

    kinds = T.StructType([*kinds.fields[:-1], T.StructField("bits", T.BinaryType())])
    rows = got.mapInArrow(had, kinds).toArrow().sort_by([("_id", "ascending"), ("bits", "ascending")])
    wide = -(-len(words) // 8)
    x = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(len(rows), wide)
    x = np.unpackbits(x, axis=1, count=len(words)).astype(np.float32) if wide else np.zeros((len(rows), 0), np.float32)
    return fit(x, {n: rows[m].to_numpy(zero_copy_only=False).astype(bool) for n, m in zip(names, marks, strict=True)}, words, folds)


def _probabilities(column, chain: Chain) -> np.ndarray:
    p = np.zeros((len(column), len(chain.names)))
    for i in range(0, len(column) if chain.links else 0, 2000):
        p[i : i + 2000] = chain.probabilities(presence(column.slice(i, 2000), chain.words))
    return p


def score(docs: DataFrame, chain: Chain, threshold: float | None = None) -> DataFrame:
    """``docs`` with ``p_<category>`` for each category and ``is_toxic`` (by the chain's threshold, unless another is given)."""
    threshold = chain.threshold if threshold is None else threshold
    sc = attach(docs.sparkSession).sparkContext
    added = [f"p_{n}" for n in chain.names]
    docs = docs.drop(*added, "is_toxic")
    at = docs.columns.index("text")
    shared = sc.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _probabilities(b.column(at), shared.value)
            cols = [*b.columns, *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= threshold)]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, *added, "is_toxic"])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in added), T.StructField("is_toxic", T.BooleanType())])
    return docs.mapInArrow(run, schema)


def drop(docs: DataFrame, labels: DataFrame, threshold: float | None = None, **params) -> DataFrame:
    """The documents that the chain does not find toxic, columns as they were. One scan besides training."""
    chain = train(docs, labels, **params)
    threshold = chain.threshold if threshold is None else threshold
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_probabilities(b.column(at), shared.value)[:, -1] < threshold))

    return docs.mapInArrow(clean, docs.schema)
