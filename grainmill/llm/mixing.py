"""Mixing sources to target weights (op 10).

Tokens (runs of non-space characters) are summed per source over the whole table. With target weights ``w_s`` (of the
sources present, normalised) and a budget of ``T`` tokens (all tokens unless given), source ``s`` is repeated at the rate
``w_s * T / (sum of w * tokens_s)``. Each document is emitted ``floor(rate)`` times, plus once more if a number drawn
from ``md5(seed:doc_id)`` lies under the fraction. Nothing is drawn at random at run time: the same rows give the same mix.

Defined cases: a null source is a source of its own (``null_weight``, else the default weight); a null or empty text has no
tokens and follows the rate of its source; a source without any token has rate 1 (there is nothing to repeat or cut); a null
doc_id draws from its text instead; rows with the same doc_id share their draw; a weight of 0 drops a source;
an empty table gives an empty result; columns named like ours in the input are kept, ours are internal except ``copy``
(an input column of that name is replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm import text as tx
from grainmill.session import attach, cut, small

WEIGHTS = {"src0": 4}
DEFAULT_WEIGHT = 1
TOKEN = "[^ \\t\\n\\r\\f\\x0B]+"


def rates(docs: DataFrame, weights: dict[str, int] | None = None, default_weight: int = DEFAULT_WEIGHT, budget: int | None = None, null_weight: int | None = None) -> DataFrame:
    """One row for each source: ``_source, _tokens, _docs, _rate``."""
    weights = WEIGHTS if weights is None else weights
    if any(w < 0 for w in (*weights.values(), default_weight, null_weight or 0)):
        raise ValueError("weights must not be negative")
    by = docs.groupBy(F.col("source").alias("_source")).agg(
        F.sum(F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long")).alias("_tokens"), F.count(F.lit(1)).alias("_docs")
    )
    w = F.when(F.col("_source").isNull(), F.lit(default_weight if null_weight is None else null_weight).cast("double"))
    for name, value in weights.items():
        w = w.when(F.col("_source") == name, F.lit(value).cast("double"))
    by = cut(by.withColumn("_w", w.otherwise(F.lit(default_weight).cast("double"))))
    total = by.agg(F.sum(F.when(F.col("_tokens") > 0, F.col("_w"))).alias("_sum_w"), F.sum("_tokens").alias("_sum_t"))
    t = F.col("_sum_t").cast("double") if budget is None else F.lit(float(budget))
    rate = F.when(F.col("_tokens") > 0, (F.col("_w") * t) / (F.col("_sum_w") * F.col("_tokens"))).otherwise(F.when(F.col("_w") > 0, 1.0).otherwise(0.0))
    return by.crossJoin(F.broadcast(total)).select("_source", "_tokens", "_docs", rate.alias("_rate"))


def mix(docs: DataFrame, weights: dict[str, int] | None = None, default_weight: int = DEFAULT_WEIGHT, budget: int | None = None, seed: int = 0, null_weight: int | None = None) -> DataFrame:
    """The documents, each as often as the rate of its source says, with the number of the copy in ``copy`` (0, 1, ...).

    Two scans and no shuffle of texts: the table of rates has a row a source and is broadcast if it is small, as its size is known by then.
    """
    attach(docs.sparkSession)
    cols = [c for c in docs.columns if c != "copy"]
    r = rates(docs, weights, default_weight, budget, null_weight).select("_source", "_rate")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col("text"), F.lit(""))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    whole = F.floor("_rate")
    times = whole + F.when(F.col("_draw") < F.col("_rate") - whole, 1).otherwise(0)
    joined = tx.packed(docs.select(*cols), _from=F.col("source"), _draw=draw).join(small(r, 100_000), F.col("_from").eqNullSafe(F.col("_source")))
    # copies in runs of runs, so that no row holds a long list whatever the rate
    copies = joined.withColumn("copy", F.lit(0).cast("long")).withColumn("_end", times).where("_end > 0")
    for step in (1 << 32, 1 << 16, 1):
        end = F.least(F.col("copy") + F.lit(step).cast("long"), F.col("_end"))
        copies = copies.withColumn("copy", F.explode(F.sequence(F.col("copy"), F.col("_end") - 1, F.lit(step).cast("long")))).withColumn("_end", end)
    return tx.unpacked(copies, cols, copy=F.col("copy"))


def sql(table: str = "documents", weights: dict[str, int] | None = None, default_weight: int = DEFAULT_WEIGHT, seed: int = 0, columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """DuckDB SQL for ``mix`` without a budget."""
    cases = "".join(f" WHEN source = '{k}' THEN {v}" for k, v in (WEIGHTS if weights is None else weights).items())
    weight = f"CASE{cases} ELSE {default_weight} END" if cases else f"{default_weight}"
    return f"""
WITH s AS (SELECT source AS ms, CAST(sum(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')), 0)) AS BIGINT) AS tokens,
                  CAST(any_value({weight}) AS DOUBLE) AS w FROM {table} GROUP BY source),
 t AS (SELECT sum(w) FILTER (tokens > 0) AS ww, CAST(sum(tokens) AS DOUBLE) AS tt FROM s),
 r AS (SELECT ms, CASE WHEN tokens > 0 THEN (w * tt) / (ww * tokens) WHEN w > 0 THEN 1.0 ELSE 0.0 END AS rate FROM s, t),
 d AS (SELECT {table}.*, rate, CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
       FROM {table} JOIN r ON source IS NOT DISTINCT FROM ms),
 n AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS times FROM d)
SELECT {columns}, unnest(range(CAST(times AS BIGINT))) AS copy FROM n"""
