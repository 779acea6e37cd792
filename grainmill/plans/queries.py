"""One query for each operator over the test tables, and the DuckDB SQL that gives the same rows.

The tables' keys are dense and in file order, so a key is its row's global number; the SQL relies on that. Queries over file units write
their table as shards to the shared folder first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.permute import M64, mix_seed
from grainmill.operators.order import POS, ROUND, SLOT, ChunkShuffle
from grainmill.plans.context import RuntimeContext
from grainmill.plans.dataset import Dataset
from grainmill.session import attach, shared_dir
from grainmill.sources import export
from grainmill.streaming import loader

SLOTS, SEED = 4, 42
CHUNK = 1000
UNIT = {"pages": 10, "orders": 250, "events": 500}
PACK = 4000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


def _data(spark: SparkSession, sf: str, name: str, slots: int = 1, seed: int = SEED, resample: bool = False, **options) -> Dataset:
    return Dataset.from_source("table", f"{sf}/{name}.parquet", RuntimeContext(world_size=slots, seed=seed), resample, spark=attach(spark), **options)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"


def _units(spark: SparkSession, sf: str, name: str, key: str, slots: int = 1, **options) -> Dataset:
    df = attach(spark).read.parquet(f"{sf}/{name}.parquet")
    files = export.parquet_files(df, F.floor(F.col(key) / UNIT[name]), F.col(key), _folder(spark))
    return Dataset.from_source("parquet", files, RuntimeContext(world_size=slots, seed=SEED), spark=spark, **options)


def _placed(d: Dataset, *cols: str, rounds: int = 1) -> DataFrame:
    return d.frame(rounds).select(*cols, F.col(SLOT).alias("slot"), F.col(ROUND).alias("round"), F.col(POS).alias("pos"))


# -- scans -----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, doc_id AS global_index, doc_id AS local_index FROM documents")
def scan_metadata(spark, sf):
    return _data(spark, sf, "documents").dataframe().select("doc_id", F.col("__global_index__").alias("global_index"), F.col("__local_index__").alias("local_index"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def scan_projection(spark, sf):
    return _data(spark, sf, "orders", columns=["o_orderkey", "o_totalprice"]).dataframe().select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey AS key, c_name AS name, c_custkey AS global_index FROM customer UNION ALL SELECT s_suppkey, s_name, s_suppkey + (SELECT count(*) FROM customer) FROM supplier")
def scan_merged_tables(spark, sf):
    folder = _folder(spark)
    for n, (t, k, v) in enumerate((("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"))):
        export.parquet_files(attach(spark).read.parquet(f"{sf}/{t}.parquet").select(F.col(k).alias("key"), F.col(v).alias("name")), F.lit(0), F.col("key"), f"{folder}/{n}")
    files = [f"{folder}/{n}/__u__=00000000" for n in (0, 1)]
    d = Dataset.from_source("table", files, RuntimeContext(), spark=spark)
    return d.dataframe().select("key", "name", F.col("__global_index__").alias("global_index"))


@query("SELECT page_id, url, page_id % 10 AS index_in_file FROM pages")
def parquet_units(spark, sf):
    f = _units(spark, sf, "pages", "page_id").dataframe()
    return f.select("page_id", "url", F.col("__index_in_file__").alias("index_in_file"))


@query("SELECT event_id, user_id, event_type, value, event_id % 500 AS index_in_file FROM events")
def jsonl_scan(spark, sf):
    df = attach(spark).read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", "value")
    files = export.jsonl_files(df, F.floor(F.col("event_id") / UNIT["events"]), F.col("event_id"), _folder(spark))
    d = Dataset.from_source("jsonl", files, RuntimeContext(), spark=spark, schema="event_id long, user_id long, event_type string, value double")
    return d.dataframe().select("event_id", "user_id", "event_type", "value", F.col("__index_in_file__").alias("index_in_file"))


def _tars(spark, sf, fields: dict, folder: str) -> list[str]:
    df = attach(spark).read.parquet(f"{sf}/pages.parquet")
    return export.tar_files(df, F.floor(F.col("page_id") / UNIT["pages"]), F.col("page_id"), F.col("page_id"), fields, folder)


@query("SELECT CAST(page_id AS VARCHAR) AS key, url, md5(html) AS html_md5, page_id % 10 AS index_in_shard FROM pages")
def tar_scan(spark, sf):
    tars = _tars(spark, sf, {"url": F.col("url"), "html": F.col("html")}, _folder(spark))
    f = Dataset.from_source("tar", tars, RuntimeContext(), spark=spark, fields=["url", "html"]).dataframe()
    return f.select(F.col("__key__").alias("key"), F.col("url").cast("string").alias("url"), F.md5("html").alias("html_md5"), F.col("__index_in_shard__").alias("index_in_shard"))


@query("SELECT CAST(page_id AS VARCHAR) AS key, url, CAST(length(html) AS INT) AS n_html FROM pages")
def sidecar_zip(spark, sf):
    main, side = _folder(spark), _folder(spark)
    tars = _tars(spark, sf, {"url": F.col("url")}, main)
    _tars(spark, sf, {"html": F.col("html")}, side)
    beside = tars[0].rsplit("/", 1)[0], side.removeprefix("file://")
    f = Dataset.from_source("tar", tars, RuntimeContext(), spark=spark, fields=["url", "html"], sidecars=[("html", lambda p: p.replace(*beside))]).dataframe()
    return f.select(F.col("__key__").alias("key"), F.col("url").cast("string").alias("url"), F.length(F.col("html").cast("string")).alias("n_html"))


@query("SELECT page_id, url AS looked_up, [url, md5(html)] AS both_of FROM pages")
def jsonl_tar_refs(spark, sf):
    folder = _folder(spark)
    tars = _tars(spark, sf, {"url": F.col("url"), "html": F.col("html")}, f"{folder}/tars")
    base = tars[0].rsplit("/", 1)[0]
    at = F.format_string("tar://%08d.tar#%d.", F.floor(F.col("page_id") / UNIT["pages"]), F.col("page_id"))
    df = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.concat(at, F.lit("url")).alias("one"), F.array(F.concat(at, F.lit("url")), F.concat(at, F.lit("html"))).alias("many"))
    files = export.jsonl_files(df, F.floor(F.col("page_id") / 100), F.col("page_id"), f"{folder}/rows")
    d = Dataset.from_source("jsonl", files, RuntimeContext(), spark=spark, schema="page_id long, one string, many array<string>", ref_fields=[("one", base), ("many", base)])
    return d.dataframe().select("page_id", F.col("one").cast("string").alias("looked_up"), F.array(F.col("many")[0].cast("string"), F.md5(F.col("many")[1])).alias("both_of"))


# -- rows ------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type, event_id AS global_index FROM events")
def select_keeps_meta(spark, sf):
    f = _data(spark, sf, "events").select(["event_type", "event_id", "no_such"]).dataframe()
    return f.select(*[c for c in f.columns if not c.startswith("__")], F.col("__global_index__").alias("global_index"))


@query("SELECT doc_id, len(string_split(text, ' ')) AS n_words, upper(lang) AS lang FROM documents")
def map_expr(spark, sf):
    d = _data(spark, sf, "documents").map({"n_words": F.size(F.split("text", " ", -1)).cast("long"), "lang": "upper(lang)"})
    return d.dataframe().select("doc_id", "n_words", "lang")


@query("SELECT doc_id, len(string_split(text, ' ')) AS n_words FROM documents")
def map_rows(spark, sf):
    return _data(spark, sf, "documents").map(lambda r: {"doc_id": r["doc_id"], "n_words": len(r["text"].split(" "))}, "doc_id long, n_words long").dataframe()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus = 'O'")
def filter_and(spark, sf):
    return _data(spark, sf, "orders", columns=["o_orderkey", "o_totalprice"]).filter("o_totalprice >= 100000").filter("o_orderstatus = 'O'").dataframe().select("o_orderkey", "o_totalprice")


@query("SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events WHERE event_type = 'click' OR value > 50")
def filter_or_list(spark, sf):
    d = _data(spark, sf, "events").filter(["event_type = 'click'", "value > 50", "event_type IN ('click')"])
    return d.frame().select("event_id", "event_type", F.col(POS).alias("pos"))


@query("SELECT event_id, value FROM events WHERE (event_type = 'click' OR value > 50) AND user_id % 2 = 0")
def filter_or_and(spark, sf):
    return _data(spark, sf, "events").filter(["event_type = 'click'", "value > 50"]).filter("user_id % 2 = 0").dataframe().select("event_id", "value")


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 2, 3) OR p_size IN (3, 4, 5)")
def filter_in_batches(spark, sf):
    return _data(spark, sf, "part").filter(["p_size IN (1, 2, 3)", "p_size IN (3, 4, 5)"]).dataframe().select("p_partkey", "p_size")


# -- order -----------------------------------------------------------------------------------------------------------


@query(f"SELECT event_id, CAST(event_id % {SLOTS} AS INT) AS slot, CAST(0 AS INT) AS round, event_id // {SLOTS} AS pos FROM events")
def slot_assignment_rows(spark, sf):
    return _placed(_data(spark, sf, "events", SLOTS), "event_id")


@query(
    f"""WITH p AS (SELECT page_id, page_id // 10 AS u FROM pages), n AS (SELECT max(u) + 1 AS n FROM p), r AS (SELECT unnest([0, 1]) AS r),
 t AS (SELECT page_id, u, r, CAST((r * n + u) % {SLOTS} AS INT) AS slot FROM p, n, r)
SELECT page_id, slot, CAST(r AS INT) AS round, row_number() OVER (PARTITION BY slot ORDER BY r, u, page_id) - 1 AS pos FROM t"""
)
def slot_assignment_units_rounds(spark, sf):
    return _placed(_units(spark, sf, "pages", "page_id", SLOTS, shuffle_mode="none"), "page_id", rounds=2)


@query("SELECT s_suppkey, CAST(r AS INT) AS round, s_suppkey + r * (SELECT count(*) FROM supplier) AS pos FROM supplier, (SELECT unnest([0, 1]) AS r)")
def resample_two_rounds(spark, sf):
    return _placed(_data(spark, sf, "supplier", resample=True), "s_suppkey", rounds=2).drop("slot")


def _mixed_sql(x: str) -> str:
    wrap = lambda e: f"CAST(({e}) % 18446744073709551616::UHUGEINT AS UBIGINT)"
    a = wrap(f"({x})::UHUGEINT + 11400714819323198485::UHUGEINT")
    b = wrap(f"xor({a}, {a} >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT")
    c = wrap(f"xor({b}, {b} >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT")
    return f"xor({c}, {c} >> 31)"


def permutation_sql(total: str, seed: int, count: str | None = None) -> str:
    """A query ``p, v``: the image v of each p < ``count`` under the permutation of 0..total - 1."""
    keys = ", ".join(f"({k}, {(seed ^ ((k + 1) * 0x9E3779B97F4A7C15)) & M64}::UBIGINT)" for k in range(8))
    return f"""WITH RECURSIVE c AS (SELECT CAST(({total}) AS BIGINT) AS n, CAST(({count or total}) AS BIGINT) AS m),
 s AS (SELECT n, m, greatest(2, CAST(floor(log2(greatest(n - 1, 1))) AS INT) + 1) AS bits FROM c),
 w AS (SELECT *, bits // 2 AS lb, bits - bits // 2 AS rb FROM s),
 k(i, key) AS (VALUES {keys}),
 f(p, v, step) AS (
  SELECT CAST(x AS BIGINT), CAST(x AS UBIGINT), 0 FROM (SELECT unnest(range(m)) AS x FROM w)
  UNION ALL
  SELECT p, CASE WHEN step % 2 = 0 THEN (l << rb) | xor(r, {_mixed_sql("xor(l, key)")} & ((1::UBIGINT << rb) - 1)::UBIGINT) ELSE (xor(l, {_mixed_sql("xor(r, key)")} & ((1::UBIGINT << lb) - 1)::UBIGINT) << rb) | r END, step + 1
  FROM (SELECT p, step, key, lb, rb, v >> rb AS l, v & ((1::UBIGINT << rb) - 1)::UBIGINT AS r FROM f, w, k WHERE i = step % 8 AND NOT (step > 0 AND step % 8 = 0 AND v < n)))
SELECT p, CAST(v AS BIGINT) AS v FROM f, w WHERE step > 0 AND step % 8 = 0 AND v < n"""


@query(f"SELECT v AS p_partkey, p AS pos FROM ({permutation_sql('SELECT count(*) FROM part', SEED)})")
def global_shuffle_positions(spark, sf):
    return _placed(_data(spark, sf, "part", shuffle_mode="global"), "p_partkey").select("p_partkey", "pos")


def _chunk_sql() -> str:
    chunks = permutation_sql(f"SELECT (count(*) + {CHUNK - 1}) // {CHUNK} FROM orders", mix_seed(SEED, 0, 0))
    return f"SELECT o_orderkey, row_number() OVER (ORDER BY p, o_orderkey) - 1 AS pos FROM orders JOIN ({chunks}) ON v = o_orderkey // {CHUNK}"


@query(_chunk_sql())
def chunk_shuffle_sequential(spark, sf):
    return _placed(_data(spark, sf, "orders", shuffle_mode="chunk", chunk_shuffle={"chunk_size": CHUNK, "k": 4, "row_order": "sequential"}), "o_orderkey").select("o_orderkey", "pos")


@query()
def chunk_shuffle_permuted(spark, sf):
    return _placed(_data(spark, sf, "orders", shuffle_mode="chunk", chunk_shuffle={"chunk_size": CHUNK, "k": 4}), "o_orderkey").select("o_orderkey", "pos")


@query()
def unit_shuffle(spark, sf):
    return _placed(_units(spark, sf, "pages", "page_id", SLOTS), "page_id", rounds=2)


# -- parts -----------------------------------------------------------------------------------------------------------


@query("WITH n AS (SELECT count(*) AS n FROM documents) SELECT doc_id, CASE WHEN doc_id < round_even(0.5 * n, 0) THEN 0 WHEN doc_id < round_even(0.8 * n, 0) THEN 1 ELSE 2 END AS part FROM documents, n")
def split_row_exact(spark, sf):
    parts = _data(spark, sf, "documents").split([0.5, 0.3, 0.2])
    out = [d.dataframe().select("doc_id", F.lit(i).alias("part")) for i, d in enumerate(parts)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    f"""WITH u AS (SELECT o_orderkey // {UNIT['orders']} AS u, count(*) AS w FROM orders GROUP BY 1),
 b AS (SELECT u, coalesce(sum(w) OVER (ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER () AS total FROM u)
SELECT o_orderkey, CASE WHEN before < 0.5 * total THEN 0 WHEN before < 0.8 * total THEN 1 ELSE 2 END AS part FROM orders JOIN b ON u = o_orderkey // {UNIT['orders']}"""
)
def split_units_weighted(spark, sf):
    parts = _units(spark, sf, "orders", "o_orderkey").split([0.5, 0.3, 0.2])
    out = [d.dataframe().select("o_orderkey", F.lit(i).alias("part")) for i, d in enumerate(parts)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    """WITH u AS (SELECT event_id // 500 AS u, count(*) AS w FROM events GROUP BY 1),
 b AS (SELECT u, coalesce(sum(w) OVER (ORDER BY sha256('7:' || u) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER () AS total FROM u)
SELECT event_id FROM events JOIN b ON u = event_id // 500 WHERE before < 0.4 * total"""
)
def sample_units_sha(spark, sf):
    return _units(spark, sf, "events", "event_id").sample(0.4, seed=7).dataframe().select("event_id")


@query(f"SELECT v AS doc_id FROM ({permutation_sql('SELECT count(*) FROM documents', 13, 'SELECT round_even(0.3 * count(*), 0) FROM documents')})")
def sample_row_exact(spark, sf):
    return _data(spark, sf, "documents").sample(0.3, seed=13).dataframe().select("doc_id")


# -- stages ----------------------------------------------------------------------------------------------------------


@query()
def shuffle_buffered(spark, sf):
    return _placed(_data(spark, sf, "events", SLOTS).shuffle(256, 64), "event_id").select("event_id", "slot", "pos")


@query("SELECT o_orderkey // 32 AS batch, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1")
def batch_sum(spark, sf):
    total = lambda c: {"n": F.size(c).cast("long"), "total": F.aggregate(c, F.lit(0).cast("decimal(18,2)"), lambda a, x: (a + x["o_totalprice"].cast("decimal(18,2)")).cast("decimal(18,2)")).cast("double")}
    f = _data(spark, sf, "orders", columns=["o_totalprice"]).batch(32, collate_fn=total).frame()
    return f.select(F.col(POS).alias("batch"), "n", "total")


@query("SELECT CAST(s AS INT) AS slot, b AS batch, list(event_id ORDER BY event_id) AS ids FROM (SELECT event_id, event_id % 4 AS s, event_id // 4 // 32 AS b FROM events) GROUP BY 1, 2 HAVING count(*) = 32")
def batch_drop_last(spark, sf):
    f = _data(spark, sf, "events", SLOTS, columns=["event_id"]).batch(32, drop_last=True, collate_fn=lambda c: {"ids": F.transform(c, lambda x: x["event_id"])}).frame()
    return f.select(F.col(SLOT).alias("slot"), F.col(POS).alias("batch"), "ids")


@query("SELECT doc_id // 16 AS batch, list(doc_id ORDER BY doc_id) AS ids, list(lang ORDER BY doc_id) AS langs FROM documents GROUP BY 1")
def batch_list(spark, sf):
    def collate(rows):
        return {"ids": [r["doc_id"] for r in rows], "langs": [r["lang"] for r in rows]}

    f = _data(spark, sf, "documents", columns=["doc_id", "lang"]).batch(16, collate_fn=collate, schema="ids array<long>, langs array<string>").frame()
    return f.select(F.col(POS).alias("batch"), "ids", "langs")


@query("SELECT doc_id, lang, doc_id AS pos FROM documents")
def unbatch_roundtrip(spark, sf):
    return _data(spark, sf, "documents", columns=["doc_id", "lang"]).batch(7).unbatch().frame().select("doc_id", "lang", F.col(POS).alias("pos"))


@query("SELECT doc_id, lang, doc_id AS pos FROM documents")
def unbatch_columns(spark, sf):
    lists = lambda c: {n: F.transform(c, lambda x: x[n]) for n in ("doc_id", "lang")}
    return _data(spark, sf, "documents", columns=["doc_id", "lang"]).batch(7, collate_fn=lists).unbatch().frame().select("doc_id", "lang", F.col(POS).alias("pos"))


class Packer:
    """Packs documents one after the other; a pack is closed before the document that would take it over its size."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.size = 0

    def _out(self) -> list[dict]:
        made = [{"ids": self.ids, "size": self.size}] if self.ids else []
        self.ids, self.size = [], 0
        return made

    def push(self, row: dict) -> list[dict]:
        made = self._out() if self.size + row["n_chars"] > PACK else []
        self.ids.append(row["doc_id"])
        self.size += row["n_chars"]
        return made

    def finish(self, *, drop_last: bool) -> list[dict]:
        return [] if drop_last else self._out()

    def state_dict(self) -> dict:
        return {"ids": self.ids, "size": self.size}

    def load_state_dict(self, state: dict) -> None:
        self.ids, self.size = list(state["ids"]), state["size"]

    def identity(self) -> str:
        return "packer"


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, n_chars, doc_id % {SLOTS} AS s, doc_id // {SLOTS} AS i FROM documents),
 p(s, i, doc_id, pack, size, n) AS (
  SELECT s, i, doc_id, 0, n_chars, n_chars FROM d WHERE i = 0
  UNION ALL
  SELECT d.s, d.i, d.doc_id, p.pack + CASE WHEN p.size + d.n_chars > {PACK} THEN 1 ELSE 0 END, CASE WHEN p.size + d.n_chars > {PACK} THEN d.n_chars ELSE p.size + d.n_chars END, d.n_chars
  FROM p JOIN d ON d.s = p.s AND d.i = p.i + 1)
SELECT CAST(s AS INT) AS slot, CAST(pack AS BIGINT) AS pack, list(doc_id ORDER BY doc_id) AS ids, CAST(sum(n) AS BIGINT) AS size FROM p GROUP BY 1, 2"""
)
def assemble_pack(spark, sf):
    f = _data(spark, sf, "documents", SLOTS, columns=["doc_id", "n_chars"]).assemble(Packer, "ids array<long>, size long").frame()
    return f.select(F.col(SLOT).alias("slot"), F.col(POS).alias("pack"), "ids", "size")


class Totals:
    """Counts regions and joins their names in the order of the stream."""

    def __init__(self) -> None:
        self.n, self.names = 0, []

    def push(self, row: dict) -> None:
        self.n += 1
        self.names.append(row["r_name"])

    def finish(self) -> tuple:
        return self.n, ",".join(self.names)


@query("""SELECT count(*) AS n, sum(l_quantity)::DOUBLE AS quantity, (SELECT count(*) FROM region) AS regions, (SELECT string_agg(r_name, ',' ORDER BY r_regionkey) FROM region) AS names FROM lineitem""")
def consume_fold(spark, sf):
    """A fold in order over a small table by a consumer, and one that needs no order as an aggregate."""
    regions, names = _data(spark, sf, "region").consume(Totals)
    sums = _data(spark, sf, "lineitem", columns=["l_quantity"]).aggregate(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    return sums.select("n", "quantity", F.lit(regions).cast("long").alias("regions"), F.lit(names).alias("names"))


class FirstIds:
    def __init__(self, k: int) -> None:
        self.k, self.got = k, []

    def push(self, row: dict) -> bool:
        self.got.append((row["event_id"],))
        return len(self.got) < self.k

    def finish(self) -> list[tuple[int]]:
        return self.got


@query("SELECT event_id FROM events WHERE event_id < 100")
def consume_early_stop(spark, sf):
    got = _data(spark, sf, "events", columns=["event_id"]).consume(lambda: FirstIds(100))
    return spark.createDataFrame(got, "event_id long")


# -- look-ups --------------------------------------------------------------------------------------------------------


def _with_ref(spark, sf, table: str, column: str, ref: str, key: str, value: str, columns: list[str]) -> Dataset:
    d = {"uri": f"{sf}/{ref}.parquet", "key_column": key, "value_column": value}
    return _data(spark, sf, table, columns=columns, ref_columns={column: d}).resolve_ref([column])


@query("SELECT l_orderkey, l_linenumber, p_name AS l_partkey FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def resolve_ref_scalar(spark, sf):
    return _with_ref(spark, sf, "lineitem", "l_partkey", "part", "p_partkey", "p_name", ["l_orderkey", "l_linenumber", "l_partkey"]).dataframe().select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT d.doc_id AS global_index, quality AS doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def resolve_ref_missing(spark, sf):
    f = _with_ref(spark, sf, "documents", "doc_id", "labels", "doc_id", "quality", ["doc_id"]).dataframe()
    return f.select(F.col("__global_index__").alias("global_index"), "doc_id")


@query(
    """WITH l AS (SELECT l_orderkey, list(p_name ORDER BY l_linenumber, l_partkey) AS names FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT o_orderkey, coalesce(names, CAST([] AS VARCHAR[])) AS parts FROM orders LEFT JOIN l ON o_orderkey = l_orderkey"""
)
def resolve_ref_list(spark, sf):
    attach(spark)
    keys = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("p"))
    rows = spark.read.parquet(f"{sf}/orders.parquet").join(keys, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    at = _folder(spark)
    rows.select("o_orderkey", F.coalesce("p", F.array().cast("array<bigint>")).alias("parts")).write.parquet(at)
    ref = {"uri": f"{sf}/part.parquet", "key_column": "p_partkey", "value_column": "p_name"}
    d = Dataset.from_source("table", at, RuntimeContext(), spark=spark, ref_columns={"parts": ref})
    return d.resolve_ref(["parts"]).dataframe().select("o_orderkey", "parts")


# -- mixes -----------------------------------------------------------------------------------------------------------

_A = "SELECT item_id AS id, 'a' AS source, 0 AS k, item_id AS i FROM benchmark"
_B = "SELECT s_suppkey AS id, 'b' AS source, 1 AS k, s_suppkey AS i FROM supplier"


def _mix(spark, sf, strategy: str, weights: dict | None = None) -> DataFrame:
    a = _data(spark, sf, "benchmark", columns=["item_id"]).map({"id": "item_id"}).select(["id"])
    b = _data(spark, sf, "supplier", columns=["s_suppkey"]).map({"id": "s_suppkey"}).select(["id"])
    d = Dataset.from_source("mixed", {"a": a, "b": b}, RuntimeContext(seed=SEED), spark=spark, strategy=strategy, weights=weights)
    return d.frame().select("id", F.col("__source__").alias("source"), F.col(POS).alias("pos"))


def _ordered(by: str) -> str:
    return f"SELECT id, source, row_number() OVER (ORDER BY {by}) - 1 AS pos FROM ({_A} UNION ALL {_B})"


@query(_ordered("k, i"))
def mixed_concat(spark, sf):
    return _mix(spark, sf, "concat")


@query(_ordered("i, k"))
def mixed_round_robin(spark, sf):
    return _mix(spark, sf, "round_robin")


@query(
    """WITH RECURSIVE n AS (SELECT (SELECT count(*) FROM benchmark) AS na, (SELECT count(*) FROM supplier) AS nb),
 w(step, ca, cb, ia, ib, live_a, live_b, pick, pos) AS (
  SELECT 0, 0, 0, 0::BIGINT, 0::BIGINT, true, true, -1, -1::BIGINT
  UNION ALL
  SELECT step + 1, a2 - CASE WHEN first THEN total ELSE 0 END, b2 - CASE WHEN first THEN 0 ELSE total END,
         ia + CASE WHEN first AND ia < na THEN 1 ELSE 0 END, ib + CASE WHEN NOT first AND ib < nb THEN 1 ELSE 0 END,
         live_a AND NOT (first AND ia >= na), live_b AND NOT (NOT first AND ib >= nb),
         CASE WHEN first AND ia < na THEN 0 WHEN NOT first AND ib < nb THEN 1 ELSE -1 END,
         pos + CASE WHEN (first AND ia < na) OR (NOT first AND ib < nb) THEN 1 ELSE 0 END
  FROM (SELECT *, live_a AND (NOT live_b OR a2 >= b2) AS first FROM
        (SELECT *, ca + CASE WHEN live_a THEN 2 ELSE 0 END AS a2, cb + CASE WHEN live_b THEN 1 ELSE 0 END AS b2,
                CASE WHEN live_a THEN 2 ELSE 0 END + CASE WHEN live_b THEN 1 ELSE 0 END AS total FROM w, n WHERE live_a OR live_b)))
SELECT CASE WHEN pick = 0 THEN ia - 1 ELSE ib - 1 END AS id, CASE WHEN pick = 0 THEN 'a' ELSE 'b' END AS source, pos FROM w WHERE pick >= 0"""
)
def mixed_weighted_round_robin(spark, sf):
    return _mix(spark, sf, "weighted_round_robin", {"a": 2, "b": 1})


@query()
def mixed_random(spark, sf):
    return _mix(spark, sf, "random")


@query()
def mixed_weighted_random(spark, sf):
    return _mix(spark, sf, "weighted_random", {"a": 2, "b": 1})


# -- materialisation, loader, resumption -----------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT event_id, event_type, event_id % 2 AS s, event_id // 2 AS i FROM events)
SELECT event_id, event_type, event_id AS source_index, row_number() OVER (ORDER BY s, i) - 1 AS pos FROM s"""
)
def snapshot_roundtrip(spark, sf):
    from grainmill.plans.cache import CacheConfig
    from grainmill.sources.paths import local

    d = _data(spark, sf, "events", 2, columns=["event_id", "event_type"]).map({"source_index": "__global_index__"})
    f = d.snapshot(config=CacheConfig(local(_folder(spark)))).at(RuntimeContext(seed=SEED)).frame()
    return f.select("event_id", "event_type", "source_index", F.col(POS).alias("pos"))


@query("SELECT event_id, event_id AS pos FROM events")
def loader_merge_round_robin(spark, sf):
    f = loader.Loader(_data(spark, sf, "events", columns=["event_id"]), num_workers=SLOTS).frame()
    return f.select("event_id", F.col(POS).alias("pos"))


@query("SELECT list(event_id ORDER BY event_id) AS ids, b AS pos FROM (SELECT event_id, event_id // 32 AS b FROM events) GROUP BY b")
def loader_batch(spark, sf):
    one = loader.Loader(_data(spark, sf, "events", columns=["event_id"]), num_workers=SLOTS)
    f = one.batch(32, collate_fn=lambda c: {"ids": F.transform(c, lambda x: x["event_id"])}).frame()
    return f.select("ids", F.col(POS).alias("pos"))


def _skewed(spark, sf) -> DataFrame:
    """Labels dealt to four ranks by skewed hash ranges."""
    slot = F.when(F.col("doc_id") % 10 < 5, 0).when(F.col("doc_id") % 10 < 8, 1).when(F.col("doc_id") % 10 < 9, 2).otherwise(3)
    f = attach(spark).read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", slot.cast("int").alias(SLOT), F.lit(0).alias(ROUND))
    from pyspark.sql import Window

    return f.withColumn(POS, (F.row_number().over(Window.partitionBy(SLOT).orderBy("doc_id")) - 1).cast("long"))


@query("SELECT CAST(r AS INT) AS rank, (SELECT count(*) FROM labels) // 4 AS n FROM (SELECT unnest([0, 1, 2, 3]) AS r)")
def balance_drop_last(spark, sf):
    return loader.balance(_skewed(spark, sf), ranks=SLOTS).groupBy(F.col(SLOT).alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, true AS even FROM labels")
def balance_dummy(spark, sf):
    """All rows, and whether every rank has as many as the others."""
    f = loader.balance(_skewed(spark, sf), ranks=SLOTS, drop_last=False, dummy_factory=lambda: {"doc_id": None, "quality": -1})
    n = f.groupBy(SLOT).agg(F.count(F.lit(1)).alias("n")).agg((F.min("n") == F.max("n")).alias("even"))
    return f.where("doc_id IS NOT NULL").select("doc_id").crossJoin(F.broadcast(n))


@query("SELECT doc_id FROM documents WHERE doc_id > 9")
def resume_continue(spark, sf):
    """Give out ten rows, save the state, and go on from it with a dataset made anew."""
    build = lambda: _data(spark, sf, "documents", columns=["doc_id"])
    d = build()
    it = iter(d)
    for _ in range(10):
        next(it)
    again = build().load_state_dict(d.state_dict())
    return spark.createDataFrame([(r["doc_id"],) for r in again], "doc_id long")


@query("SELECT list(s_suppkey ORDER BY i) AS ids, CAST(b AS BIGINT) AS pos FROM (SELECT s_suppkey, r * n + s_suppkey AS i, (r * n + s_suppkey) // 7 AS b FROM supplier, (SELECT count(*) AS n FROM supplier), (SELECT unnest(range(4)) AS r)) WHERE b < (SELECT 4 * count(*) // 7 FROM supplier) GROUP BY b")
def resampled_batches_resumed(spark, sf):
    """Batches of 7 of a source that is repeated, over the ends of rounds; half-way the state is saved and a dataset made anew goes on."""
    size = lambda c: {"ids": F.transform(c, lambda x: x["s_suppkey"])}
    build = lambda: _data(spark, sf, "supplier", resample=True, columns=["s_suppkey"]).batch(7, collate_fn=size)
    d = build()
    want = 4 * d.source.rows // 7
    it = iter(d)
    got = [next(it)["ids"] for _ in range(want // 2)]
    it = iter(build().load_state_dict(it.state_dict()))
    got += [next(it)["ids"] for _ in range(want - len(got))]
    return spark.createDataFrame([([int(x) for x in b], i) for i, b in enumerate(got)], "ids array<long>, pos long")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Filter, narrow, take the first half, batch by 32 and sum up each batch."""
    d = _data(spark, sf, "documents", columns=["doc_id", "n_chars"]).filter("n_chars > 0").split([0.5, 0.5])[0]
    sums = lambda c: {"n": F.size(c), "n_chars": F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["n_chars"])}
    f = d.select(["doc_id", "n_chars"]).batch(32, collate_fn=sums).frame()
    return f.select(F.col(POS).alias("batch"), "n", "n_chars")


QUERIES["flagship"] = flagship
SQL["flagship"] = """WITH d AS (SELECT n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents WHERE n_chars > 0)
SELECT i // 32 AS batch, CAST(count(*) AS INT) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM d WHERE i < round_even(0.5 * n, 0) GROUP BY 1"""
