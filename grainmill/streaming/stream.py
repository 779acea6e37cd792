"""Unbounded and resumable reading (O9, R1, R4, T4): a Structured Streaming query over the places of a table's order.

The stream carries numbers only, from Spark's own micro-batch counter, whose offsets are in the query's checkpoint. A number is a round and
a place in it; the place's row follows by the forward permutation of that round and is joined from the table. So a stopped query goes on
where it was, repeats nothing, and a repeated source has no end.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions.permute import permuted
from grainmill.operators import stages
from grainmill.operators.order import POS, ROUND, SLOT
from grainmill.plans.dataset import Dataset
from grainmill.sources import table

LOCAL = ("map", "select")


def stream(dataset: Dataset, rows_per_batch: int = 1_000_000, partitions: int | None = None) -> DataFrame:
    """A streaming frame of ``dataset`` (a table, order ``none`` or ``global``; stages map and select) with slot, round and place.

    Without ``resample`` the numbers beyond the first round give no rows.
    """
    d = dataset
    mode = d.options.get("shuffle_mode", "none")
    if d.kind not in ("table", "lance") or mode not in ("none", "global") or d.filters or d.selection:
        raise ValueError("[UnsupportedStream] streams read whole tables in order none or global")
    if bad := [s.kind for s in d.stages if s.kind not in LOCAL]:
        raise ValueError(f"[UnsupportedStream] {bad[0]} reaches over rows; use assemble below or a bounded run")
    spark, n, slots = d.spark, d.source.rows, d.context.total_slots
    numbers = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("numPartitions", partitions or spark.sparkContext.defaultParallelism).load()
    r, p = F.floor(F.col("value") / max(1, n)), F.pmod(F.col("value"), F.lit(max(1, n)))
    at = numbers.select(r.cast("int").alias(ROUND), p.cast("long").alias("__eff__"))
    if not d.resample:
        at = at.where(F.col(ROUND) == 0)
    row = F.col("__eff__") if mode == "none" else permuted(F.col("__eff__"), n, d.context.seed, False, F.col(ROUND))
    slot = F.pmod(F.col("__eff__"), F.lit(slots))
    per_round = F.floor((F.lit(n - 1) - slot) / slots) + 1
    at = at.withColumns({"__row__": row, SLOT: slot.cast("int"), POS: (F.col(ROUND) * per_round + F.floor(F.col("__eff__") / slots)).cast("long")}).drop("__eff__")
    rows = table.scan(spark, d.source, d.options.get("columns"))
    out = at.join(rows, F.col("__row__") == F.col("__global_index__")).drop("__row__")
    out = out.select(*rows.columns, SLOT, ROUND, POS)
    for s in d.stages:
        out = s.apply(out, d.context)
    return out


def assemble(df: DataFrame, factory: Callable[[], object], schema: str | T.StructType) -> DataFrame:
    """The state machine of ``stages.assemble`` over a stream, one per slot, its ``state_dict()`` kept in the state store.

    A stream has no end, so ``finish`` is never called: what the machine holds back at the end stays in its state.
    """
    out = T.StructType([T.StructField(SLOT, T.IntegerType()), *stages.fields(schema)])
    state = T.StructType([T.StructField("held", T.BinaryType())])

    def run(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        machine = factory()
        if held.exists:
            machine.load_state_dict(pickle.loads(held.get[0]))
        rows = pd.concat(list(parts)).sort_values(POS)
        made = [r for row in rows.drop(columns=[SLOT, ROUND, POS]).to_dict("records") for r in machine.push(row) or ()]
        held.update((pickle.dumps(machine.state_dict()),))
        yield pd.DataFrame([{SLOT: key[0], **r} for r in made], columns=out.names)

    return df.groupBy(SLOT).applyInPandasWithState(run, out, state, "append", "NoTimeout")
