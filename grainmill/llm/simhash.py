"""SimHash near-dedup (op 3) with a Gray-order hierarchical index.

Fingerprint: 128 bits over the set of distinct words (lower case, runs of letters and digits); a word shorter than
``LONG`` bytes weighs ``SHORT_WEIGHT``, as short words are mostly those that all texts of a language share.

Search, exact: all pairs of distinct fingerprints that differ in at most ``h`` bits. The bits are ``BLOCKS`` blocks of 16, and block i
has a limit t_i such that the sum of all t_i + 1 is h + 1; a half of four blocks has the sum of their t_i + 1, less 1, as its limit. So a near pair is within the limit of one half, there
within that of some block i, and is equal in one of t_i + 1 pieces of that block.
Each fingerprint goes to the bucket of each of its h + 1 pieces. In a bucket fingerprints are sorted by the Gray rank of their bits, the half of the block first and rotated so
that the block leads: neighbours in this order differ in few bits. Runs of ``GROUP`` become nodes of the first level, runs of
``FAN`` nodes those of the next, until few are left; a node keeps a mask of the bits that all its members share and their pattern. Two
nodes can hold a near pair only if the shared bits of both differ in at most ``h`` places, in at most t_i of the block and in no more of the half than its limit, so whole pairs of groups are pruned by
the differences accumulated there, from the top down; the children of two nodes, or their members, are compared all with all, and the second half only where the differences so far allow.
A pair counts in the first piece that it meets in, so once. Buckets of more than ``BUCKET_ROWS`` are dealt into chunks, and each pair of chunks
is a task: no bucket has to fit into one, however many fingerprints or however alike they are.

Groups: the pairs' connected components, from a spanning forest per bucket (so that thousands of copies don't make millions
of edges), by repeated minimum over neighbours and pointer jumping. Pairs are counted where they are found and never sent. One row of each group stays: that of the lowest doc_id.

Defined cases: a null text, or one without a word, has no fingerprint, is never a copy and always stays; so does a row with a null doc_id;
equal fingerprints are one group; rows that repeat a doc_id are one document for ``groups``, and ``dedup`` keeps one row
of it, the lowest by (text, other columns); an empty table gives an empty result; other columns are carried along untouched; doc_id has to be an integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.llm import text as tx
from grainmill.session import attach, cut, cut_round, small

H = 24
BLOCKS = 8
GROUP = 8
FAN = 16
#: Pairs that are compared at a time; their differences (8 bytes each) should stay in a core's cache.
TILE = 1 << 16
LONG = 5
SHORT_WEIGHT = 0.25
#: Fingerprints in a chunk of a bucket (32 bytes each, several times over while they are sorted).
BUCKET_ROWS = 2_000_000
_U = np.uint64


def fingerprints(column, long: int = LONG, short_weight: float = SHORT_WEIGHT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: the upper and lower 64 bits, and its number of distinct words (0: no fingerprint)."""
    raw, off = tx.utf8(pc.utf8_lower(pc.fill_null(column, "")))
    n = len(off) - 1
    hi, lo, count = np.zeros(n, _U), np.zeros(n, _U), np.zeros(n, np.int64)
    for a, b in tx.slices(off, 1 << 19):
        part, o = raw[off[a] : off[b]], off[a : b + 1] - off[a]
        s, e, first = tx.spans(part, o, tx.ALNUM)
        if not len(s):
            continue
        h = tx.span_hashes(part, s, e)
        w = np.where(e - s >= long, np.float32(1), np.float32(short_weight))
        doc = np.repeat(np.arange(b - a), np.diff(first))
        order = np.lexsort((h, doc)) if b - a > 1 else np.argsort(h, kind="stable")
        h, w, doc = h[order], w[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, w, doc = h[new], w[new], doc[new]
        at = np.searchsorted(doc, np.arange(b - a + 1))
        count[a:b] = np.diff(at)
        halves = np.empty((len(h), 2), ">u8")
        halves[:, 0], halves[:, 1] = h, tx.mix64(h ^ _U(0xA5A5A5A55A5A5A5A))
        bits = np.unpackbits(halves.view(np.uint8).reshape(len(h), 16), axis=1).astype(np.float32)
        total = np.zeros((b - a, 128), np.float32)
        for d in np.flatnonzero(np.diff(at)):
            x, y = at[d], at[d + 1]
            total[d] = w[x:y] @ bits[x:y] - w[x:y].sum() / 2
        packed = np.packbits(total > 0, axis=1).view(">u8").astype(_U)
        hi[a:b], lo[a:b] = packed[:, 0], packed[:, 1]
    return hi, lo, count


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    """64 bits rotated to the left, so that bit ``by`` leads."""
    return (x << _U(by)) | (x >> _U(64 - by)) if by else x


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of each 64-bit pattern in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> _U(s)
    return x


def _nodes(ones: np.ndarray, zeros: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For nodes over the rows from one of ``at`` to the next: the bits (n, 2) that are one, and zero, in all members."""
    return np.bitwise_and.reduceat(ones, at, axis=0), np.bitwise_and.reduceat(zeros, at, axis=0)


def _cuts(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Where nodes of at most ``size`` rows begin, so that none reaches over one of ``starts``."""
    since = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    return np.flatnonzero(since % size == 0)


def _cross(a: np.ndarray, b: np.ndarray, edge: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of children of the node pairs (a, b), some at a time; node k has the children edge[k]..edge[k + 1] - 1."""
    na, nb = edge[a + 1] - edge[a], edge[b + 1] - edge[b]
    total = np.cumsum(na * nb)
    s = 0
    while s < len(a):
        e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + limit, "right")))
        n = na[s:e] * nb[s:e]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        u, v = np.divmod(k, np.repeat(nb[s:e], n))
        i, j = np.repeat(edge[a[s:e]], n) + u, np.repeat(edge[b[s:e]], n) + v
        k = i <= j  # within a node each pair once
        yield i[k], j[k]
        s = e


def _true(k: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of a contiguous mask, faster if few are true."""
    k = k.ravel()
    n = len(k) // 8 * 8
    w = np.flatnonzero(k[:n].view(_U))
    at = np.flatnonzero(k[:n].reshape(-1, 8)[w])
    return np.append(8 * w[at // 8] + at % 8, n + np.flatnonzero(k[n:]))


def near_pairs(x: np.ndarray, starts: np.ndarray, h: int, group: int = GROUP, lead: int = 0, within: int = 0, half: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows (i < j) of one run that differ in at most ``h`` bits, of the first ``lead`` bits in at most ``within`` and of the first 64 in at most ``half``.

    x: (n, 2) uint64 in Gray order within each run; starts: where the runs begin. Yields index arrays.
    """
    n = len(x)
    if not n:
        return
    cuts = _cuts(starts, n, group)
    levels = [(*_nodes(x, ~x, cuts), np.append(cuts, n))]  # shared ones, shared zeros, where the children begin
    first = np.searchsorted(cuts, starts)
    while np.diff(np.append(first, len(cuts))).max() > FAN:
        o, z, _ = levels[-1]
        up = _cuts(first, len(cuts), FAN)
        levels.append((*_nodes(o, z, up), np.append(up, len(cuts))))
        first, cuts = np.searchsorted(up, first), up
    drop, least = _U(64 - lead) if lead else None, min(h, half)
    one, two = np.ascontiguousarray(x[:, 0]), np.ascontiguousarray(x[:, 1])
    halves = [tuple(np.ascontiguousarray(c[:, k]) for k in (0, 1) for c in (o, z)) for o, z, _ in levels]  # ones, zeros of the first half, of the second

    def alike(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether nodes can hold a near pair."""
        o, z, p, q = halves[level]
        u = (o[i] & z[j]) | (z[i] & o[j])
        n = np.bitwise_count(u)
        k = (n <= half) & (n + np.bitwise_count((p[i] & q[j]) | (q[i] & p[j])) <= h)
        return k & (np.bitwise_count(u >> drop) <= within) if lead else k

    def descend(level: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # children of some pairs of nodes at a time, each of one node with each of the other: only those that the first half leaves are looked at one by one
        edge, wide = levels[level][2], FAN if level else group
        step = max(1, TILE // wide**2)
        for s in range(0, len(a), step):
            c, d = a[s : s + step], b[s : s + step]
            i, j = edge[c] + np.arange(wide)[:, None], edge[d] + np.arange(wide)[:, None]  # (child, pair)
            full = i < edge[c + 1], j < edge[d + 1]
            i, j = np.minimum(i, edge[-1] - 1), np.minimum(j, edge[-1] - 1)
            if level:
                o, z = halves[level - 1][:2]
                u = (o[i][:, None] & z[j]) | (z[i][:, None] & o[j])
                k = np.bitwise_count(u >> drop) <= within if lead else np.bitwise_count(u) <= least
            else:
                k = np.bitwise_count(one[i][:, None] ^ one[j]) <= least
            if not all(f.all() for f in full):
                k &= full[0][:, None] & full[1]
            at, k = np.divmod(_true(k), len(c))
            u, v = np.divmod(at, wide)
            i, j = i[u, k], j[v, k]
            k = i <= j if level else i < j  # within a node each pair once
            i, j = i[k], j[k]
            if level:
                k = alike(level - 1, i, j)
                yield from descend(level - 1, i[k], j[k])
                continue
            u = one[i] ^ one[j]
            k = np.bitwise_count(u) + np.bitwise_count(two[i] ^ two[j]) <= h  # the first half is within its limit
            if lead:
                k &= np.bitwise_count(u >> drop) <= within
            if k.any():
                yield i[k], j[k]

    runs = np.arange(len(starts))
    for i, j in _cross(runs, runs, np.append(first, len(cuts))):
        k = alike(len(levels) - 1, i, j)
        yield from descend(len(levels) - 1, i[k], j[k])


def _together(pairs: Iterator[tuple[np.ndarray, np.ndarray]], least: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, at least so many at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for p in pairs:
        held.append(p)
        n += len(p[0])
        if n >= least:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


class _Forest:
    """Union-find over 0..n-1 that keeps the edges that joined two trees."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for _ in range(64):  # flatten, so that pairs in one tree drop out without a Python step each
            flat = self.up[self.up]
            if (flat == self.up).all():
                break
            self.up = flat
        k = self.up[a] != self.up[b]
        for i, j in zip(a[k].tolist(), b[k].tolist()):
            r, s = self.root(i), self.root(j)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                self.edges.append((i, j))


def pieces(h: int) -> list[tuple[int, int, int, int]]:
    """(block, limit of the block, first bit in the block, bits) of each piece; near pairs agree in one whose block is within its limit."""
    out = []
    for b in range(BLOCKS):
        n = (h + 1) // BLOCKS + (b < (h + 1) % BLOCKS)  # the limit + 1
        edge = [16 * i // n for i in range(n + 1)] if n else []
        out += [(b, n - 1, x, y - x) for x, y in zip(edge, edge[1:])]
    return out


def _half(h: int, block: int) -> int:
    """The limit of the half that ``block`` lies in: near pairs are within that of one half, and then within that of one of its blocks."""
    return sum(b // 4 == block // 4 for b, *_ in pieces(h)) - 1


def _earlier(u: np.ndarray, k: int, h: int) -> np.ndarray:
    """Whether pairs with the differences ``u`` (n, 2) meet in a piece before ``k``."""
    out = np.zeros(len(u), bool)
    for b, limit, at, bits in pieces(h)[:k]:
        block = (u[:, b // 4] >> _U(48 - 16 * (b % 4))) & _U(0xFFFF)
        out |= (np.bitwise_count(u[:, b // 4]) <= _half(h, b)) & (np.bitwise_count(block) <= limit) & ((block >> _U(16 - at - bits)) & _U((1 << bits) - 1) == 0)
    return out


def _bucket(table: pa.Table, h: int, group: int) -> pa.Table:
    """Of one bucket, or of a pair of its chunks: a spanning forest (a, b; links null), and the links of each fingerprint (a; b null)."""
    k, one, two = (int(table[c][0].as_py()) for c in ("piece", "one", "two"))
    block, limit, _, _ = pieces(h)[k]
    ids, many = table["id"].to_numpy(), table["n"].to_numpy()
    x = np.stack([table[c].to_numpy().view(_U) for c in ("hi", "lo")], axis=1)
    r = np.stack([_rotate(x[:, block // 4], 16 * (block % 4)), x[:, 1 - block // 4]], axis=1)
    order = np.lexsort((gray_rank(r[:, 1]), gray_rank(r[:, 0])))
    x, r, ids, many, mine = x[order], r[order], ids[order], many[order], table["own"].to_numpy()[order]
    forest, links = _Forest(len(ids)), np.zeros(len(ids), np.int64)
    for a, b in _together(near_pairs(r, np.zeros(1, np.int64), h, group, 16, limit, _half(h, block))):
        ok = ~_earlier(x[a] ^ x[b], k, h) & (ids[a] != ids[b])
        if one != two:
            ok &= mine[a] != mine[b]
        a, b = a[ok], b[ok]
        np.add.at(links, a, many[b])
        np.add.at(links, b, many[a])
        forest.join(a, b)
    e = np.array(forest.edges, np.int64).reshape(-1, 2)
    has = np.flatnonzero(links)
    return pa.table({
        "a": np.concatenate([ids[e[:, 0]], ids[has]]),
        "b": pa.array(np.concatenate([ids[e[:, 1]], ids[has]]), mask=np.arange(len(e) + len(has)) >= len(e)),
        "links": pa.array(np.concatenate([np.zeros(len(e), np.int64), links[has]]), mask=np.arange(len(e) + len(has)) < len(e)),
    })


def _sketch(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hi, lo, n = fingerprints(b.column(1))
            k = n > 0
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(k)), pa.array(hi[k].view(np.int64)), pa.array(lo[k].view(np.int64))], ["doc_id", "hi", "lo"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return slim.mapInArrow(run, "doc_id long, hi long, lo long")


def near(points: DataFrame, h: int = H, group: int = GROUP) -> DataFrame:
    """Of all pairs of ``points`` (id, hi, lo; n documents each) at a distance of at most ``h``: edges ``a, b`` of spanning forests, and ``a, links`` to add up.

    Shuffled: a row of 40 bytes for each point and piece; a point of a bucket with c chunks is in c tasks.
    """
    places = []
    for k, (b, _, at, bits) in enumerate(pieces(h)):
        value = F.shiftrightunsigned("hi" if b < 4 else "lo", 64 - 16 * (b % 4) - at - bits).bitwiseAND(F.lit((1 << bits) - 1))
        places.append(F.struct(F.lit(k).alias("piece"), value.cast("int").alias("value")))
    routed = points.select("id", "hi", "lo", "n", F.explode(F.array(*places)).alias("k")).select("id", "hi", "lo", "n", "k.piece", "k.value")
    # how many chunks a bucket has; there are at most 25 * 2**16 buckets, however many points, and only the large ones are listed
    large = routed.groupBy("piece", "value").count().where(F.col("count") > BUCKET_ROWS).collect() if points.count() > BUCKET_ROWS else []
    chunks = F.lit(1)
    if large:
        listed = F.create_map(*[F.lit(y) for r in large for y in (f"{r[0]}:{r[1]}", -(-r[2] // BUCKET_ROWS))])
        chunks = F.coalesce(F.try_element_at(listed, F.concat_ws(":", "piece", "value")), F.lit(1))
    routed = routed.withColumn("c", chunks).withColumn("own", F.pmod(F.xxhash64("hi", "lo"), F.col("c")).cast("int"))
    routed = routed.select("*", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other")).select(
        "id", "hi", "lo", "n", "piece", "value", "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two")
    )
    return routed.groupBy("piece", "value", "one", "two").applyInArrow(lambda t: _bucket(t, h, group), "a long, b long, links long")


def components(pairs: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``id, root`` for every id in ``pairs`` (a, b): root is the lowest id of its connected component."""
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    e = cut_round(pairs.select(F.explode(both).alias("e")).select("e.a", "e.b").distinct())
    label = cut_round(e.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    for _ in range(max_rounds):
        by_edge = e.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("seen"))
        step = label.join(by_edge, "id").select("id", F.least("root", "seen").alias("root"), F.col("root").alias("old"))
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("up"))
        new = cut_round(step.join(jump, "root").select("id", F.least("root", "up").alias("root"), (F.least("root", "up") != F.col("old")).alias("moved")))
        label = new.select("id", "root")
        if not new.where("moved").limit(1).count():
            return label
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")


def groups(docs: DataFrame, h: int = H) -> DataFrame:
    """``doc_id, group_id, links`` for each document that has a near copy: group_id is the doc_id that stays, links the number of its near copies.

    Shuffled: 24 bytes a document for equal fingerprints, then about 40 bytes a distinct fingerprint and piece. Texts are never shuffled.
    """
    attach(docs.sparkSession)
    prints = cut(_sketch(docs).distinct())
    points = cut(prints.groupBy("hi", "lo").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")))
    found = cut(near(points, h))
    root = components(found.where("b IS NOT NULL").select("a", "b"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("more"))
    same = points.join(root.join(links, "id"), "id", "left").where("root IS NOT NULL OR n > 1")
    same = same.select("hi", "lo", F.coalesce("root", "id").alias("group_id"), (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("links"))
    # a doc_id with several texts is one document with the links of all
    return prints.join(same, ["hi", "lo"]).groupBy("doc_id").agg(F.min("group_id").alias("group_id"), F.sum("links").alias("links"))


def dedup(docs: DataFrame, h: int = H) -> DataFrame:
    """``docs`` with one document of each group of near copies; columns as they were.

    Only the ids to drop are joined; they are broadcast if they are few, else both sides are shuffled by doc_id.
    """
    attach(docs.sparkSession)
    key = F.col("doc_id").cast("long")
    gone = small(cut(groups(docs, h).where("doc_id <> group_id").select(F.col("doc_id").alias("_gone"))))
    kept = tx.packed(docs, _key=key).join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    again = cut(docs.groupBy(key.alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 AND _again IS NOT NULL").select("_again"))
    if not again.limit(1).count():
        return tx.unpacked(kept, docs.columns)
    again = small(again)
    twice = kept.join(again, F.col("_key") == F.col("_again"), "left_semi")
    order = [F.col("_row").getField(c) for c in ("text", *(c for c in docs.columns if c not in ("text", "doc_id"))) if _sortable(docs.schema[c].dataType)]
    one = twice.withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_rank = 1").drop("_rank")
    return tx.unpacked(kept.join(again, F.col("_key") == F.col("_again"), "left_anti").unionByName(one), docs.columns)


def _sortable(kind: T.DataType) -> bool:
    return not any(x in kind.simpleString() for x in ("map<", "variant", "void", "interval"))
