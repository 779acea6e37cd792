"""Language identification by hierarchical discrimination (op 7): first the family, then close languages within it.

Features: square roots of the shares of the hashed byte 2- and 3-grams (lower case) of the whole text. The family is chosen by linear
support vector machines, one against the rest; in a family, one machine for each pair of its languages votes, and ties go
to the larger sum of margins, then to the name. A language that is in no known family is a family of its own.

Trained on a bounded sample: at most ``max_rows`` rows with a language, as many of each as can be, those with the least hash of doc_id.

Defined cases: a null text, or one under two bytes, has a null family and language; rows without a language aren't trained on; if no row has
one, all results are null; repeated rows get the same result; columns of the input that are called as ours are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.llm import linear
from grainmill.llm import text as tx
from grainmill.session import attach, cut, small

FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
FAMILY = {lang: fam for fam, langs in FAMILIES.items() for lang in langs}
MAX_ROWS = 2000
DIMS = 2048


def family(lang: str) -> str:
    return FAMILY.get(lang, lang)


def features(column, dims: int = DIMS) -> np.ndarray:
    """A row for each text; all zero if it has no 2-gram."""
    raw, off = tx.utf8(pc.utf8_lower(pc.fill_null(column, "")))
    x = np.zeros((len(off) - 1, dims), np.float32)
    for a, b in tx.slices(off, 1 << 19):
        part, o = raw[off[a] : off[b]].astype(np.uint32), off[a : b + 1] - off[a]
        n, d = len(part), b - a
        if n < 2:
            continue
        with np.errstate(over="ignore"):
            two = part[:-1] * np.uint32(0x9E3779B1) + part[1:] * np.uint32(0x85EBCA77)
            three = two[: n - 2] * np.uint32(0xC2B2AE3D) + part[2:] * np.uint32(0x27D4EB2F)
            two *= np.uint32(0x165667B1)
        row = np.repeat(np.arange(d, dtype=np.int64) * dims, np.diff(o))
        # grams that reach into the next text don't count
        k2 = np.ones(n, bool)
        ends = o[1:][np.diff(o) > 0]
        k2[ends - 1] = False
        k3 = k2[: n - 2] & k2[1 : n - 1] if n > 2 else np.zeros(0, bool)
        k2 = k2[: n - 1]
        shift = np.uint32(32 - (dims.bit_length() - 1))
        c = np.bincount((row[: n - 1] + (two >> shift))[k2], minlength=d * dims)
        if n > 2:
            c = c + np.bincount((row[: n - 2] + (three >> shift))[k3], minlength=d * dims)
        c = c.reshape(d, dims)
        x[a:b] = np.sqrt(c / np.maximum(1, c.sum(axis=1, keepdims=True)))
    return x


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    langs: dict[str, list[str]] = field(default_factory=dict)
    w: np.ndarray | None = None  # dims x machines
    b: np.ndarray | None = None
    pairs: list[tuple[str, str, str]] = field(default_factory=list)  # family, first, second: after the families' machines

    def predict(self, x: np.ndarray) -> tuple[list, list]:
        n = len(x)
        if not self.families:
            return [None] * n, [None] * n
        z = x @ self.w + self.b
        empty = ~x.any(axis=1)
        f = z[:, : len(self.families)].argmax(axis=1)
        fam = [None if e else self.families[i] for i, e in zip(f, empty)]
        lang: list = [None] * n
        for i, name in enumerate(self.families):
            rows = np.flatnonzero((f == i) & ~empty)
            langs = self.langs[name]
            votes = np.zeros((len(rows), len(langs)))
            margin = np.zeros((len(rows), len(langs)))
            for k, (fm, p, q) in enumerate(self.pairs):
                if fm == name:
                    m = z[rows, len(self.families) + k]
                    u, v = langs.index(p), langs.index(q)
                    votes[:, u] += m >= 0
                    votes[:, v] += m < 0
                    margin[:, u] += m
                    margin[:, v] -= m
            best = np.lexsort((-np.arange(len(langs))[None, :].repeat(len(rows), 0), margin, votes), axis=1)[:, -1] if len(rows) else []
            for r, c in zip(rows, best):
                lang[r] = langs[c]
        return fam, lang


def fit(x: np.ndarray, langs: list[str]) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model()
    y = np.array(langs)
    fams = np.array([family(v) for v in langs])
    m = Model(sorted(set(fams.tolist())))
    ws, bs = [], []
    for f in m.families:
        m.langs[f] = sorted(set(y[fams == f].tolist()))
        w, b = linear.svm(x, fams == f) if len(m.families) > 1 else (np.zeros(x.shape[1], np.float32), 0.0)
        ws.append(w)
        bs.append(b)
    for f in m.families:
        for p, q in combinations(m.langs[f], 2):
            k = (y == p) | (y == q)
            w, b = linear.svm(x[k], y[k] == p)
            ws.append(w)
            bs.append(b)
            m.pairs.append((f, p, q))
    m.w, m.b = np.stack(ws, axis=1).astype(np.float32), np.array(bs, np.float32)
    return m


def train(docs: DataFrame, max_rows: int = MAX_ROWS, dims: int = DIMS) -> Model:
    """Fit on a bounded sample of the rows that have a language. The sampled ids are broadcast (bounded), texts aren't shuffled."""
    attach(docs.sparkSession)
    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    each = max(1, max_rows // max(1, known.select("_lang").distinct().limit(max_rows + 1).count()))
    # the least hashes are found without a window over a whole language: a threshold first, from counts of 4,096 hash ranges
    h = F.pmod(F.xxhash64("_id"), F.lit(4096))
    upto = F.sum("n").over(Window.partitionBy("_lang").orderBy("h"))
    counts = known.groupBy("_lang", h.alias("h")).agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
    limits = counts.groupBy("_lang").agg(F.coalesce(F.min(F.when(F.col("upto") >= each, F.col("h"))), F.lit(4095)).alias("_limit"))
    near = known.join(small(cut(limits)), "_lang").where(h <= F.col("_limit"))
    by = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    sample = near.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= each).select("_id", "_lang").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(2), dims)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "lang", "x"])

    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(sample), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("_id", "_lang", "text")
    got = rows.mapInArrow(run, "id long, lang string, x binary").toArrow().sort_by("id")
    if not len(got):
        return Model()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(len(got), dims)
    return fit(x, got["lang"].to_pylist())


def identify(docs: DataFrame, model: Model, dims: int = DIMS) -> DataFrame:
    """``docs`` with ``family`` and ``predicted``."""
    sc = attach(docs.sparkSession).sparkContext
    docs = docs.drop("family", "predicted")
    at = docs.columns.index("text")
    shared = sc.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fam, lang = [], []
            for i in range(0, len(b), 1000):
                f, p = shared.value.predict(features(b.column(at).slice(i, 1000), dims))
                fam += f
                lang += p
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fam, pa.string()), pa.array(lang, pa.string())], [*b.schema.names, "family", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("family", T.StringType()), T.StructField("predicted", T.StringType())])
    return docs.mapInArrow(run, schema)
