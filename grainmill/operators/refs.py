"""Look-ups by key (J1, J3): left outer equi joins of scalar or list cells, and of tar members by address."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.session import attach
from grainmill.sources import table as tables
from grainmill.sources.paths import local


@dataclass(frozen=True)
class Ref:
    """Where the values of a key column are: one or more tables, their key and value column."""

    uris: tuple[str, ...]
    key: str
    value: str

    @classmethod
    def of(cls, name: str, spec: object) -> Ref:
        if isinstance(spec, cls):
            return spec
        if not isinstance(spec, dict):
            raise ValueError(f"[InvalidLanceRefColumn] {name}: a mapping with uri, key_column and value_column is needed")
        uri = spec.get("uri")
        uris = (uri,) if isinstance(uri, str) else tuple(uri or ())
        if not uris or not all(isinstance(u, str) and u for u in uris):
            raise ValueError(f"[InvalidLanceRefColumn] {name}: uri must be an address or a list of them")
        for k in ("key_column", "value_column"):
            if not isinstance(spec.get(k), str) or not spec[k]:
                raise ValueError(f"[InvalidLanceRefColumn] {name}: {k} is missing")
        return cls(uris, spec["key_column"], spec["value_column"])


def _checked(ref: DataFrame, wanted: DataFrame) -> DataFrame:
    """``ref`` (k, v) for the keys in ``wanted`` (k, distinct); a key that is there twice is an error. Null keys match nothing."""
    got = ref.where("k IS NOT NULL").join(wanted, "k", "left_semi")
    one = got.groupBy("k").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"))
    bad = F.raise_error(F.concat(F.lit("[DuplicateLanceRefKey] key is there more than once: "), F.col("k").cast("string"))).cast("boolean")
    return one.where(F.when(F.col("n") > 1, bad).otherwise(F.lit(True))).select("k", "v")


def resolve(df: DataFrame, column: str, ref: DataFrame, key: str, value: str, row: Sequence[str], hint: str | None = None) -> DataFrame:
    """Replace ``column``, a key or a list of keys, by the values of ``ref``.

    A missing or null key gives null; a null list null, an empty list an empty one; in a list null keys are left out and missing ones give null, in order.
    ``row`` names columns that tell rows apart (only lists need them). The value side is narrowed to the keys asked for before it is joined,
    duplicates among them are an error. ``hint``: broadcast, merge, shuffle_hash; otherwise adaptive execution decides.
    """
    v = ref.select(F.col(key).alias("k"), F.col(value).alias("v"))
    listed = isinstance(df.schema[column].dataType, T.ArrayType)
    if not listed:
        keys = df.select(F.col(column).alias("k")).where("k IS NOT NULL").distinct()
        right = _checked(v, keys).select(F.col("k").alias("__k__"), F.col("v").alias("__v__"))
        right = right.hint(hint) if hint else right
        out = df.join(right, df[column] == F.col("__k__"), "left")
        return out.select(*[F.col("__v__").alias(c) if c == column else df[c] for c in df.columns])
    flat = df.select(*row, F.posexplode(F.filter(column, lambda x: x.isNotNull())).alias("__i__", "k"))
    right = _checked(v, flat.select("k").distinct())
    right = right.hint(hint) if hint else right
    got = flat.join(right, "k", "left").groupBy(*row).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i__", "v"))), lambda x: x["v"]).alias("__vs__"))
    marked = got.select(*[F.col(c).alias(f"__r{i}__") for i, c in enumerate(row)], "__vs__")
    on = [df[c].eqNullSafe(F.col(f"__r{i}__")) for i, c in enumerate(row)]
    empty = F.array().cast(marked.schema["__vs__"].dataType)
    cell = F.when(df[column].isNotNull(), F.coalesce("__vs__", empty))
    return df.join(marked, on, "left").select(*[cell.alias(c) if c == column else df[c] for c in df.columns])


def ref_table(spark: SparkSession, ref: Ref) -> DataFrame:
    """The tables of a reference, one after the other."""
    return tables.scan(spark, tables.discover(ref.uris), [ref.key, ref.value] if ref.key != ref.value else [ref.key], meta=False)


_URI = re.compile(r"(?:tar://)?(.+)#([^#]+)\.([^.#]+(?:\.[^#]+)?)", re.S)


def parse_uri(uri: str, base: str = "") -> tuple[str, str, str]:
    """``[tar://]shard#key.field`` as (shard, key, field); the key ends at its first dot, relative shards start from ``base``."""
    body = uri[6:] if uri.startswith("tar://") else uri
    shard, sep, member = body.partition("#")
    key, dot, name = member.partition(".")
    if not (sep and dot and shard and key and name) or "#" in member:
        raise ValueError(f"[InvalidTarUri] {uri!r} is not [tar://]shard#key.field")
    import os

    return (shard if os.path.isabs(shard) or not base else os.path.join(base, shard)), key, name


def tar_members(df: DataFrame, column: str, base: str, row: Sequence[str], level: int = 1) -> DataFrame:
    """Replace addresses of tar members, one or a list a cell, by their bytes. A member that isn't there is an error; null stays null.

    Addresses are gathered by tar, each tar is read once in one pass, and the bytes are joined back.
    """
    attach(df.sparkSession)
    listed = isinstance(df.schema[column].dataType, T.ArrayType)

    @F.pandas_udf("shard string, member string")
    def parsed(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            rows = [parse_uri(u, base) if u is not None else (None, None, None) for u in s]
            yield pd.DataFrame({"shard": [r[0] for r in rows], "member": [r[1] and f"{r[1]}.{r[2]}" for r in rows]})

    asked = (df.select(F.explode(column).alias("u")) if listed else df.select(F.col(column).alias("u"))).where("u IS NOT NULL").distinct()

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        import tarfile
        from os.path import basename

        want = dict.fromkeys(pdf["member"])
        with tarfile.open(local(pdf["shard"].iloc[0]), "r|*") as tar:
            for m in tar:
                if m.isfile() and (b := basename(m.name)) in want and want[b] is None:
                    want[b] = tar.extractfile(m).read()
        if missing := [k for k, v in want.items() if v is None]:
            raise ValueError(f"[TarMemberNotFound] {pdf['shard'].iloc[0]} has no {missing[0]}")
        return pd.DataFrame({"k": pdf["u"], "v": [want[m] for m in pdf["member"]]})

    got = asked.select("u", parsed("u").alias("p")).select("u", "p.shard", "p.member").groupBy("shard").applyInPandas(read, "k string, v binary")
    return resolve(df, column, got, "k", "v", row)
