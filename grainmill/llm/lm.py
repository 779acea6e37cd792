"""LM scoring by cross-entropy difference (op 4): how much better a text suits a target model than a background model.

Both models are bigram models of the same order, smoothing and vocabulary: every word of the whole corpus (lower case, runs of
letters and digits), and one mark for the beginning of a text; a word that the corpus lacks counts as unknown. With ``vocab_size`` the vocabulary is that
many most frequent words (ties by hash), and all others are one unknown word. The target
model is counted over the documents whose label has ``quality > 0``, the background model over all others; every document counts.
``p(w | v) = (c(v, w) + MU * p(w)) / (c(v) + MU)`` with ``p(w) = (c(w) + 1) / (N + V)``. The result has, per token, the
losses under both models (nats) and ``score``, the difference target - background: low for texts like the target.

A gram is a bigram, a word or a word as predecessor, named by a 64-bit hash; the counts of all grams are one table in as many parts (ranges of
the hash) as the corpus needs. Documents are packed into chunks; a chunk asks each part for the counts of its distinct grams and works out its losses from
the answers. Counts and answers are arrays of a part and a chunk, not rows; if the texts are those that the models are of, a chunk sends its counts
with its question, so that its grams are shuffled once. Neither the driver nor any one task holds the vocabulary or a model.

Defined cases: a null text, or one without a word, has 0 tokens and null losses; a null doc_id, or one without a label, is background; a doc_id
labelled twice is target if any label says so; without any target (or background) document that model is uniform; repeated rows
count each time; columns of the input that are called as ours are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.llm import text as tx
from grainmill.session import attach, cut, small

MU = 10.0
ADDED = ["n_tokens", "target_loss", "background_loss", "score"]
#: Tokens of the corpus to a part of the table of counts; bytes of text to a chunk; grams that a task sums before it sends them on.
PART_TOKENS, CHUNK_BYTES, SUM_GRAMS = 2_000_000, 12 << 20, 800_000
#: Losses are multiples of this, so that their sums are exact in any order.
GRAIN = 2.0**-24
_U = np.uint64
_UNKNOWN, _BEGIN = _U(0), _U(1)
_OWN, _BEFORE, _PAIR = tx.mix64(np.arange(1, 4, dtype=_U))


def _words(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of texts: from, to, word hashes, first word of each text."""
    raw, off = tx.utf8(pc.utf8_lower(pc.fill_null(column, "")))
    for a, b in tx.slices(off):
        part, o = raw[off[a] : off[b]], off[a : b + 1] - off[a]
        s, e, first = tx.spans(part, o, tx.ALNUM)
        yield a, b, (tx.span_hashes(part, s, e) if len(s) else np.zeros(0, _U)), first


def _chunks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in chunks of about ``CHUNK_BYTES`` of the text in column ``at``."""
    held, size = [], 0
    for batch in batches:
        _, off = tx.utf8(batch.column(at))
        for a, b in tx.slices(off, CHUNK_BYTES):
            held.append(batch.slice(a, b - a))
            size += int(off[b] - off[a])
            if size >= CHUNK_BYTES // 2:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _tokens(column, vocab: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts (those outside of ``vocab``, if there is one, as unknown), and the first word of each text."""
    hashes, firsts, n = [np.zeros(0, _U)], [np.zeros(1, np.int64)], 0
    for _, _, h, first in _words(column):
        hashes.append(h)
        firsts.append(first[1:] + n)
        n += len(h)
    h = np.concatenate(hashes)
    if vocab is not None:
        h[tx.lookup(h, vocab) < 0] = _UNKNOWN
    return h, np.concatenate(firsts)


def _grams(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct grams of texts, ascending, and for each token the places of its bigram, its predecessor and itself among them."""
    u, own = np.unique(h, return_inverse=True)
    w = np.append(u, _BEGIN)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[first[:-1][first[:-1] < first[1:]]] = len(u)
    own, before, code = own.astype(np.int32), before.astype(np.int32), before * len(w) + own
    code, pair = np.unique(code, return_inverse=True)
    pair = pair.astype(np.int32)
    v, x = np.divmod(code, len(w))
    with np.errstate(over="ignore"):
        keys = np.concatenate([tx.mix64(tx.mix64(w ^ _PAIR)[v] + w[x]), tx.mix64(w ^ _BEFORE), tx.mix64(u ^ _OWN)])
    del v, x
    order = np.argsort(keys)
    place = np.empty(len(keys), np.int32)
    place[order] = np.arange(len(keys), dtype=np.int32)
    return keys[order], place[pair], place[len(code) + before], place[len(code) + len(w) + own]


def _bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins among ascending ``keys``, and their number."""
    return np.searchsorted(((keys >> _U(32)) * _U(parts)) >> _U(32), np.arange(parts + 1, dtype=_U))


def _planes(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, of 4 planes if they fit, else 8, compressed: most planes are nearly nothing then."""
    x = x.astype("<u4" if not len(x) or x.max() < 1 << 32 else "<u8")
    return bytes([x.itemsize]) + pa.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), "zstd", asbytes=True)


def _numbers(planes: bytes, n: int) -> np.ndarray:
    """What ``_planes`` was given, of ``n`` numbers."""
    if not n:
        return np.zeros(0, _U)
    x = np.frombuffer(pa.decompress(planes[1:], planes[0] * n, "zstd"), np.uint8).reshape(-1, n).T
    return np.ascontiguousarray(x).view(f"<u{x.shape[1]}").ravel().astype(_U)


def _sent(keys: np.ndarray) -> bytes:
    """Ascending keys as planes of their differences."""
    return _planes(np.diff(keys, prepend=_U(0)))


def _keys(sent: bytes, n: int) -> np.ndarray:
    """What ``_sent`` was given."""
    return np.cumsum(_numbers(sent, n), dtype=_U)


def _counted(places: list[np.ndarray], n: int, mine: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """How often each of ``n`` grams is in the texts that are, and in those that aren't, ``mine``."""
    t = np.repeat(mine, np.diff(first))
    return [sum(np.bincount(x[m], minlength=n) for x in places) for m in (t, ~t)]


def _sum(keys: list[np.ndarray], *counts: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    k, inv = np.unique(np.concatenate(keys), return_inverse=True)
    return [k, *(np.bincount(inv, np.concatenate(c), minlength=len(k)).astype(np.int64) for c in counts)]


def marked(docs: DataFrame, labels: DataFrame, mark: str = "_target") -> DataFrame:
    """``docs`` with a last column ``mark``, whether it is labelled as good."""
    key = mark + "_"
    good = cut(labels.where("doc_id IS NOT NULL AND quality > 0").select(F.col("doc_id").alias(key)).distinct())
    return docs.join(small(good), docs["doc_id"] == F.col(key), "left").select(*[docs[c] for c in docs.columns], F.col(key).isNotNull().alias(mark))


def vocabulary(docs: DataFrame) -> DataFrame:
    """``h, target, background``: how often each word, by its hash, is in the documents with and without ``_target``."""

    def summed(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        k, t, b = _sum(*held)
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(t), pa.array(b)], ["h", "target", "background"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            mine = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, z, h, first in _words(batch.column(0)):
                u, inv = np.unique(h, return_inverse=True)
                t = np.repeat(mine[a:z], np.diff(first))
                for x, y in zip(held, (u, np.bincount(inv, t, len(u)), np.bincount(inv, ~t, len(u))), strict=True):
                    x.append(y)
            if sum(map(len, held[0])) > SUM_GRAMS:
                yield from summed(held)
                held = [[], [], []]
        if held[0]:
            yield from summed(held)

    rows = docs.mapInArrow(run, "h long, target long, background long")
    return rows.groupBy("h").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def counts(docs: DataFrame, vocab: np.ndarray | None, parts: int) -> DataFrame:
    """``part, n, keys, target, background``: grams and how often they are in the documents with and without ``_target``; a gram may be in several rows."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def summed(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        k, t, b = _sum(*held)
        at = _bounds(k, parts)
        for p in np.flatnonzero(np.diff(at)):
            i = slice(at[p], at[p + 1])
            row = [p], [at[p + 1] - at[p]], [_sent(k[i])], [_planes(t[i])], [_planes(b[i])]
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(row, (pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["part", "n", "keys", "target", "background"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        for chunk in _chunks(batches, 0):
            h, first = _tokens(chunk.column(0), shared.value)
            if not len(h):
                continue
            keys, *places = _grams(h, first)
            both = _counted(places, len(keys), chunk.column(1).to_numpy(zero_copy_only=False).astype(bool), first)
            for x, y in zip(held, (keys, *both), strict=True):
                x.append(y)
            if sum(map(len, held[0])) > SUM_GRAMS:
                yield from summed(held)
                held = [[], [], []]
        if held[0]:
            yield from summed(held)

    return docs.mapInArrow(run, "part int, n long, keys binary, target binary, background binary")


@dataclass
class Models:
    docs: DataFrame  # what the models are of; their grams are counted when texts are scored
    rows: DataFrame  # the same, ``marked`` in the last column
    vocab: np.ndarray | None  # sorted hashes; None: every word
    words: int  # in the vocabulary
    tokens: tuple[int, int]  # target, background
    mu: float


def train(docs: DataFrame, labels: DataFrame, vocab_size: int | None = None, mu: float = MU) -> Models:
    """Both models over all documents. Only with ``vocab_size`` words come to the driver, that many at most."""
    attach(docs.sparkSession)
    rows = marked(docs, labels, "_" * (1 + max(map(len, docs.columns))))  # a name that no column has
    words = vocabulary(rows.select("text", rows.columns[-1]))
    vocab = None
    if vocab_size is not None:
        words = cut(words)
        top = words.orderBy(F.desc(F.col("target") + F.col("background")), "h").limit(vocab_size)
        vocab = np.sort(np.array([r[0] for r in top.select("h").collect()], np.int64).view(_U))
    n, t, b = words.agg(F.count("*"), F.sum("target"), F.sum("background")).first()
    return Models(docs, rows, vocab, n if vocab is None else len(vocab), (t or 0, b or 0), mu)


def _packed(docs: DataFrame, at: int) -> DataFrame:
    """``chunk, bytes, rows``: documents in chunks, as Arrow streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = TaskContext.get().partitionId() << 32
        for chunk in _chunks(batches, at):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, chunk.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 7))) as w:
                w.write_batch(chunk)
            size = pc.sum(pc.binary_length(chunk.column(at))).as_py() or 0
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([size], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["chunk", "bytes", "rows"])
            i += 1

    return docs.mapInArrow(run, "chunk long, bytes long, rows binary")


def _opened(rows: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(rows).read_next_batch()


def score(docs: DataFrame, models: Models) -> DataFrame:
    """``docs`` with ``n_tokens, target_loss, background_loss, score``."""
    sc = attach(docs.sparkSession).sparkContext
    same = docs.sameSemantics(models.docs)
    docs = docs.drop(*ADDED)
    at, width = docs.columns.index("text"), len(docs.columns)
    chunks = cut(_packed(models.rows.drop(*ADDED) if same else docs, at))
    size = chunks.agg(F.sum("bytes")).first()[0] or 0
    parts = 1 + max(sum(models.tokens), size // 6) // PART_TOKENS
    shared = sc.broadcast(models.vocab)
    v, tokens, mu = models.words + 2, models.tokens, models.mu

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs = _opened(rows.as_py())
                h, first = _tokens(docs.column(at), shared.value)
                mine = docs.column(width).to_numpy(zero_copy_only=False).astype(bool) if same else None
                del docs
                if not len(h):
                    continue
                keys, *places = _grams(h, first)
                both = [np.zeros(0, np.int64)] * 2 if mine is None else _counted(places, len(keys), mine, first)
                del h, places
                b = _bounds(keys, parts)
                p = np.flatnonzero(np.diff(b))
                cols = [pa.array(f(x[b[i] : b[i + 1]]) for i in p) for f, x in zip((_sent, _planes, _planes), (keys, *both), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(np.full(len(p), chunk)), pa.array(np.diff(b)[p]), *cols], ["part", "chunk", "n", "keys", "target", "background"])

    def answer(known: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        n = known["n"].to_pylist()
        of = [[f(x.as_py(), k) for x, k in zip(known[c], n, strict=True)] for c, f in (("keys", _keys), ("target", _numbers), ("background", _numbers))]
        keys, *both = _sum(*of) if n else [np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for part, chunk, k, x in zip(*(asked[c] for c in ("part", "chunk", "n", "keys")), strict=True):
            i = tx.lookup(_keys(x.as_py(), k.as_py()), keys)
            got = (np.where(i < 0, 0, c[i]) if len(keys) else np.zeros(len(i), np.int64) for c in both)
            for o, y in zip(out, (chunk.as_py(), part.as_py(), k.as_py(), *map(_planes, got)), strict=True):
                o.append(y)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], ["chunk", "part", "n", "target", "background"])

    def tell(packed: pa.Table, answers: pa.Table) -> pa.Table:
        b = _opened(packed["rows"][0].as_py())
        h, first = _tokens(b.column(at), shared.value)
        n = np.diff(first)
        means = [np.zeros(len(b)), np.zeros(len(b))]
        if len(h):
            _, pair, before, own = _grams(h, first)
            answers = answers.sort_by("part")
            for k, name in enumerate(("target", "background")):
                c = np.concatenate([_numbers(x.as_py(), m.as_py()) for x, m in zip(answers[name], answers["n"], strict=True)]).astype(np.float64)
                p = (c[own] + 1) / (tokens[k] + v)
                loss = -np.log((c[pair] + mu * p) / (c[before] + mu))
                means[k] = tx.per_doc(np.round(loss / GRAIN) * GRAIN, first) / np.maximum(n, 1)
        lt, lb = means
        cols = [pa.array(n.astype(np.int64)), *(pa.array(x, mask=n == 0) for x in (lt, lb, lt - lb))]
        return pa.Table.from_arrays([*b.columns[:width], *cols], [*b.schema.names[:width], *ADDED])

    told = "chunk long, part int, n long, target binary, background binary"
    asks = chunks.select("chunk", "rows").mapInArrow(ask, "part int, chunk long, n long, keys binary, target binary, background binary")
    if same:
        answers = asks.groupBy("part").applyInArrow(lambda t: answer(t, t), told)
    else:
        known = counts(models.rows.select("text", models.rows.columns[-1]), models.vocab, parts)
        answers = known.groupBy("part").cogroup(asks.groupBy("part")).applyInArrow(answer, told)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ADDED[1:])])
    return chunks.select("chunk", "rows").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tell, schema)


def sql(mu: float = MU) -> str:
    """DuckDB SQL for ``score`` of the documents that the models are of, where doc_ids are unique: every bigram by itself."""
    loss = lambda c, n: f"round_even(-ln((p.{c} + {mu} * (o.{c} + 1) / ({n} + words + 2)) / (b.{c} + {mu})) * {1 / GRAIN}, 0) * {GRAIN}"
    count = "count(*) FILTER (good) AS t, count(*) FILTER (NOT good) AS b"
    return rf"""
WITH d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality > 0) AS good, coalesce(regexp_extract_all(lower(text), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), []) AS ws FROM documents),
 g AS (SELECT doc_id, coalesce(good, false) AS good, unnest(ws) AS w, unnest(list_concat([''], ws[1:len(ws) - 1])) AS v FROM d WHERE len(ws) > 0),
 p AS (SELECT v, w, {count} FROM g GROUP BY v, w), b AS (SELECT v, {count} FROM g GROUP BY v), o AS (SELECT w, {count} FROM g GROUP BY w),
 n AS (SELECT count(DISTINCT w) AS words, count(*) FILTER (good) AS nt, count(*) FILTER (NOT good) AS nb FROM g),
 s AS (SELECT g.doc_id, sum({loss("t", "nt")}) AS t, sum({loss("b", "nb")}) AS b FROM g JOIN p USING (v, w) JOIN b USING (v) JOIN o USING (w), n GROUP BY g.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, t / len(ws) AS target_loss, b / len(ws) AS background_loss, t / len(ws) - b / len(ws) AS score
FROM d LEFT JOIN s USING (doc_id)"""
