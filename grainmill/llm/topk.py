"""Exact top-k search (op 2): branch and bound over columns.

Vectors are kept in vertical layout, in blocks of ``STEP`` dimensions. Squared distances of a query to the candidates of a block of
rows are accumulated one block of dimensions after the other. After each the mass that is left, the norms of the remaining dimensions, bounds what
can still be added: at least ``(|q_rest| - |x_rest|)**2``. Candidates whose bound exceeds the k-th best distance known so far
for their query are dropped and the survivors compacted, so that each further block of dimensions is read for them alone. Dimensions are taken in order of falling
variance, which is summed over the whole table, so the bounds tighten early.

Queries are the rows whose id is divisible by ``every``; each is held against all rows. Rows are dealt into blocks by hash; first the queries of each block are
searched in it, which gives every query a bound; then each block of queries meets each block of rows in a task that begins from these bounds, and the best k of
all are merged. A row is sent to one task for every ``BLOCK`` queries, a query to one for every ``BLOCK`` rows.

Result: ``vec_id, neighbour_id, distance, rank``, Euclidean, rounded to 6 digits, ties by neighbour_id. A row is not its own neighbour.

Defined cases: rows with a null id, a null vector, or one with null or not finite elements or of another than the commonest dimension (the larger of two
equally common) are left out on both sides; rows that repeat an id are one query per row and may be each other's neighbours only under different ids; fewer than k others
give fewer rows; an empty table, or one without a query, gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.session import attach, cut

K = 10
STEP = 16
BLOCK = 8192
EVERY = 50
#: Queries whose first block of dimensions is computed at once, before any candidate is out.
QUERIES = 64
DIGITS = 6
#: Partial distances are computed as |a|^2 - 2ab + |b|^2; this much of both squared norms may be lost on the way.
SAFE = 1e-12


def _matrix(column, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances row by row, summed dimension by dimension: the same for a pair wherever it is computed."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += (q[:, j] - x[:, j]) ** 2
    return np.round(np.sqrt(total), DIGITS)


def _blocks(x: np.ndarray, cuts: list[int], step: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Blocks of dimensions, the squared norms in each, and the norms of all that comes after each."""
    parts = [np.ascontiguousarray(x[:, c : c + step]) for c in cuts]
    norms = [(p**2).sum(axis=1) for p in parts]
    rest = np.cumsum([np.zeros(len(x)), *norms[:0:-1]], axis=0)[::-1]
    return parts, norms, [np.sqrt(r) for r in rest]


def search(qid: np.ndarray, q: np.ndarray, bound: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of x (with another id) to each row of q, if within ``bound``: query row, x row, distance."""
    cuts = list(range(0, len(order), step))
    (qp, qn, qr), (xp, xn, xr) = _blocks(q[:, order], cuts, step), _blocks(x[:, order], cuts, step)
    qq, xx = sum(qn), sum(xn)
    slack = SAFE * len(order)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, len(q), QUERIES):
        first = qn[0][s : s + QUERIES, None] - 2 * (qp[0][s : s + QUERIES] @ xp[0].T) + xn[0][None, :]
        for i, acc in enumerate(first, s):
            tau = bound[i]
            if not np.isfinite(tau) and len(x) > k:
                # a first bound: the distances to those that the first block of dimensions puts nearest
                near = np.argpartition(acc, min(len(x), 2 * k + 8) - 1)[: 2 * k + 8]
                near = near[xid[near] != qid[i]]
                if len(near) >= k:
                    tau = np.partition(distances(q[np.full(len(near), i)], x[near]), k - 1)[k - 1]
            limit = (tau + 10.0**-DIGITS) ** 2 + slack * (qq[i] + xx)
            alive = None  # all; else their places, ascending
            for n in range(len(cuts)):
                if n:
                    part = xp[n] if alive is None else xp[n][alive]
                    acc = acc + (qn[n][i] - 2 * (part @ qp[n][i]) + (xn[n] if alive is None else xn[n][alive]))
                left = xr[n] if alive is None else xr[n][alive]
                keep = acc + (qr[n][i] - left) ** 2 <= limit
                if not keep.all():
                    alive = np.flatnonzero(keep) if alive is None else alive[keep]
                    acc, limit = acc[keep], limit[keep]
            j = np.arange(len(x)) if alive is None else alive
            j = j[xid[j] != qid[i]]
            if len(j):
                d = distances(q[np.full(len(j), i)], x[j])
                o = np.lexsort((xid[j], d))[:k]
                out.append((np.full(len(o), i), j[o], d[o]))
    if not out:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def search_all(vectors: DataFrame, k: int = K, block: int = BLOCK, step: int = STEP, every: int = EVERY) -> DataFrame:
    """The ``k`` nearest other rows of each row of ``vectors`` (vec_id, embedding) whose id is divisible by ``every``."""
    spark = attach(vectors.sparkSession)
    schema = "vec_id long, neighbour_id long, distance double, rank int"
    # single precision is shuffled as such and widened where it is used
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & (F.size("v") > 0))
    common = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dims, n = common[0], common[1]
    v = v.where(F.size("v") == dims)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((2, dims))
        for b in batches:
            m = _matrix(b.column(0), dims)
            s += np.stack([m.sum(axis=0), (m**2).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(s[0]), pa.array(s[1])], ["j", "s", "ss"])

    m = v.select("v").mapInArrow(moments, "j int, s double, ss double").groupBy("j").agg(F.sum("s"), F.sum("ss")).collect()
    var = np.zeros(dims)
    for j, s, ss in m:
        var[j] = ss / n - (s / n) ** 2
    order = np.lexsort((np.arange(dims), -var))
    blocks = max(1, -(-n // block))
    rows = cut(v.withColumn("row", F.monotonically_increasing_id()).withColumn("b", F.pmod(F.xxhash64("id", "row"), F.lit(blocks)).cast("int")))

    def own(t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        asks = np.flatnonzero(ids % every == 0)
        x = _matrix(t["v"], dims)
        i, _, d = search(ids[asks], x[asks], np.full(len(asks), np.inf), ids, x, k, order, step)
        bound = np.full(len(asks), -np.inf)
        np.maximum.at(bound, i, d)
        bound[np.bincount(i, minlength=len(asks)) < k] = np.inf
        t = t.take(pa.array(asks))
        return pa.table({"id": t["id"], "row": t["row"], "v": t["v"], "bound": bound})

    queries = cut(rows.groupBy("b").applyInArrow(own, f"id long, row long, v {kind}, bound double"))
    tiles = max(1, -(-queries.count() // block))
    # a task for each block of queries and each block of rows
    every_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asking = queries.select("*", F.lit(True).alias("asks"), F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int").alias("qb")).withColumn("xb", every_of(blocks))
    asked = rows.select("id", "row", "v", F.lit(None).cast("double").alias("bound"), F.lit(False).alias("asks"), every_of(tiles).alias("qb"), F.col("b").alias("xb"))

    def pair(t: pa.Table) -> pa.Table:
        asks = t["asks"].to_numpy(zero_copy_only=False)
        qt, xt = t.filter(pa.array(asks)), t.filter(pa.array(~asks))
        ids, row, xid = qt["id"].to_numpy(), qt["row"].to_numpy(), xt["id"].to_numpy()
        if not len(ids) or not len(xid):
            i = j = np.zeros(0, np.int64)
            d = np.zeros(0)
        else:
            i, j, d = search(ids, _matrix(qt["v"], dims), qt["bound"].to_numpy(), xid, _matrix(xt["v"], dims), k, order, step)
        return pa.table({"id": ids[i], "row": row[i], "other": xid[j], "d": d})

    found = asking.unionByName(asked).groupBy("qb", "xb").applyInArrow(pair, "id long, row long, other long, d double")
    by = Window.partitionBy("row").orderBy("d", "other")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(F.col("id").alias("vec_id"), F.col("other").alias("neighbour_id"), F.col("d").alias("distance"), "rank")


def sql(k: int = K, every: int = EVERY) -> str:
    return f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
 d AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_distance(a.v, b.v), {DIGITS}) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS INT) AS rank FROM d)
SELECT vec_id, neighbour_id, distance, rank FROM r WHERE rank <= {k}"""
