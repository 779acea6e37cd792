"""Sources, stages, look-ups, snapshots, resumption, loader and streams."""

import json
import os
import sys
import tarfile
import io

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import grainmill
from grainmill import CacheConfig, Dataset, Loader, ResumeStateError, RuntimeContext
from grainmill.operators.order import POS, ROUND, SLOT
from grainmill.plans import cache, codecs, identity
from grainmill.plans.queries import FirstIds, Packer, _data
from grainmill.sources import export, files, paths, readers, table
from grainmill.streaming import loader as loading
from grainmill.streaming import stream as streaming

ROWS = [{"id": f"sample-{i}", "text": f"text-{i}", "value": i} for i in range(6)]
SCHEMA = "id string, text string, value long"


def _tar(path, samples):
    with tarfile.open(path, "w") as t:
        for name, content in samples:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))


@pytest.fixture
def shards(spark, tmp_path):
    for s in range(2):
        mine = ROWS[s::2]
        _tar(tmp_path / f"shard_{s}.tar", [(f"dir/{r['id']}.{k}", str(v).encode()) for r in mine for k, v in r.items()] + [("dir/__meta__", b"x"), ("dir/nodot", b"x")])
        (tmp_path / f"rows_{s}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in mine))
        spark.createDataFrame([tuple(r.values()) for r in mine], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"t{s}"))
        os.rename(next((tmp_path / f"t{s}").glob("*.parquet")), tmp_path / f"rows_{s}.parquet")
    return tmp_path


def test_paths(tmp_path):
    assert paths.resolve("a{008..010}.tar::b.tar") == ["a008.tar", "a009.tar", "a010.tar", "b.tar"]
    assert paths.resolve("x{2..0}") == ["x2", "x1", "x0"]
    assert paths.resolve(str(tmp_path / "none*")) == [str(tmp_path / "none*")]
    with pytest.raises(ValueError):
        paths.resolve("")


@pytest.mark.parametrize("kind", ["tar", "jsonl", "parquet"])
def test_every_source_reads_all_rows(spark, shards, kind):
    opts = {"tar": {"fields": ["id", "text", "value"]}, "jsonl": {"schema": SCHEMA}, "parquet": {}}[kind]
    d = Dataset.from_source(kind, str(shards / f"{'shard' if kind == 'tar' else 'rows'}_{{0..1}}.{kind}"), RuntimeContext(world_size=2), spark=spark, **opts)
    rows = d.frame().collect()
    assert sorted(r.id.decode() if kind == "tar" else r.id for r in rows) == [r["id"] for r in ROWS]
    assert {r[SLOT] for r in rows} == {0, 1}
    one = [r for r in d.rows()]
    assert len(one) == 3 and all("__key__" in r for r in one)
    by = {"tar": "__index_in_shard__"}.get(kind, "__index_in_file__")
    assert [r[by] for r in one] == [0, 1, 2]


@pytest.mark.parametrize("ending", ["", "\n"])
@pytest.mark.parametrize("size", [1, 7, 1 << 22])
def test_lines_are_read_in_blocks(tmp_path, ending, size):
    lines = ["{}", "", '{"x": "é"}', "a" * 50, "  ", "last"]
    at = tmp_path / "x.jsonl"
    at.write_bytes(("\r\n".join(lines[:3]) + "\n" + "\n".join(lines[3:]) + ending).encode())
    u = files.Unit(str(at))
    got = [x for b in files.read_lines(0, u, size) for x in b.column(2).to_pylist()]
    assert got == lines and files._lines(str(at)) == 6
    raw = at.read_bytes()
    for each in (1, 2, 4, 6, 9):
        starts = files._starts(str(at), each)
        assert [raw[s:].split(b"\n")[0].decode().rstrip("\r") for s in starts] == lines[::each]
        part = files.Unit(str(at), 2, 3, files._starts(str(at), 2)[1])
        assert [x for b in files.read_lines(0, part, size) for x in b.column(2).to_pylist()] == lines[2:5]
    at.write_bytes(b"")
    assert files._lines(str(at)) == 0 and files._starts(str(at), 2) == [] and list(files.read_lines(0, u)) == []


def test_many_units_share_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "WAVES", 1, raising=False)
    monkeypatch.setattr(files, "UNITS_A_TASK", 16, raising=False)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # units go over the ends of batches
    try:
        rows = spark.range(0, 200, 1, 3).withColumn("n", F.col("id") * 10)
        at = [export.jsonl_files(rows, F.floor(F.col("id") / 5), -F.col("id"), str(tmp_path / "j")), export.tar_files(rows, F.floor(F.col("id") / 5), -F.col("id"), F.col("id"), {"n": F.col("n").cast("string")}, str(tmp_path / "t"))]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert [len(x) for x in at] == [40, 40]
    assert [json.loads(x) for x in open(at[0][1])] == [{"id": i, "n": i * 10} for i in (9, 8, 7, 6, 5)]
    d = Dataset.from_source("jsonl", at[0], RuntimeContext(), spark=spark, schema="id long, n long", shuffle_mode="none")
    assert [r["id"] for r in d.rows()] == [5 * u + 4 - i for u in range(40) for i in range(5)]
    t = Dataset.from_source("tar", at[1], RuntimeContext(), spark=spark, fields=["n"], shuffle_mode="none")
    assert [(r["__key__"], r["n"]) for r in t.rows()] == [(str(i), str(i * 10).encode()) for i in (5 * u + 4 - i for u in range(40) for i in range(5))]
    assert files.scan_tar(spark, t.source, ["n"]).rdd.getNumPartitions() == 4  # of 40 units


def test_many_files_are_listed_in_few_tasks(spark, tmp_path):
    at = export.parquet_files(spark.range(200), F.floor(F.col("id") / 2), F.col("id"), str(tmp_path / "p"))
    assert len(at) == 100
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    had = spark.conf.get(name)
    group = "listing"
    spark.sparkContext.setJobGroup(group, group)
    try:
        d = Dataset.from_source("parquet", at, RuntimeContext(), spark=spark, shuffle_mode="none")
        df = files.scan_parquet(spark, d.source)
        track = spark.sparkContext.statusTracker()
        stages = [track.getStageInfo(s) for j in track.getJobIdsForGroup(group) for s in track.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert stages and max(s.numTasks for s in stages if s) <= files.WAVES * spark.sparkContext.defaultParallelism
    assert spark.conf.get(name) == had
    assert sorted((r.id, r["__index_in_file__"]) for r in df.collect()) == [(i, i % 2) for i in range(200)]


def test_split_of_jsonl_lines_for_more_slots_than_files(spark, shards):
    d = Dataset.from_source("jsonl", str(shards / "rows_0.jsonl"), RuntimeContext(world_size=3), spark=spark, schema=SCHEMA)
    assert sorted(r.value for r in d.frame().collect()) == [0, 2, 4]
    assert len({r[SLOT] for r in d.frame().collect()}) == 3


def test_bad_shards(spark, shards):
    (shards / "bad.jsonl").write_text('{"id": "a"}\n[1]\n')
    d = Dataset.from_source("jsonl", str(shards / "bad.jsonl"), RuntimeContext(), spark=spark, schema="id string")
    with pytest.raises(Exception, match="InvalidJsonLine.*line 2"):
        d.frame().collect()
    with pytest.raises(ValueError, match="InvalidSourceType"):
        Dataset.from_source("tar", str(shards / "bad.jsonl"), RuntimeContext(), spark=spark)
    with pytest.raises(ValueError, match="InsufficientTarShards"):
        Dataset.from_source("tar", str(shards / "shard_0.tar"), RuntimeContext(world_size=2), spark=spark)
    _tar(shards / "twice.tar", [("a.x", b"1"), ("a.x", b"2")])
    with pytest.raises(Exception, match="InvalidSampleKey"):
        Dataset.from_source("tar", str(shards / "twice.tar"), RuntimeContext(), spark=spark).frame().collect()
    with pytest.raises(ValueError, match="UnsupportedTarShuffleMode"):
        Dataset.from_source("tar", str(shards / "shard_0.tar"), RuntimeContext(), spark=spark, shuffle_mode="global")
    with pytest.raises(TypeError):
        Dataset.from_source("tar", str(shards / "shard_0.tar"), RuntimeContext(), spark=spark, nonsense=1)


@pytest.mark.parametrize(("side", "tag"), [([("sample-0.mask", b"1")], "SidecarLengthMismatch"), ([("other.mask", b"1")], "SidecarKeyMismatch"), ([("sample-0.text", b"1")], "SidecarFieldConflict")])
def test_sidecars_that_do_not_fit(spark, shards, side, tag):
    _tar(shards / "side.tar", side)
    d = Dataset.from_source("tar", str(shards / "shard_0.tar"), RuntimeContext(), spark=spark, sidecars=[("mask", lambda p: str(shards / "side.tar"))])
    with pytest.raises(Exception, match=tag):
        d.frame().collect()


def test_missing_tar_member(spark, shards):
    (shards / "refs.jsonl").write_text('{"a": "tar://shard_0.tar#sample-0.text"}\n{"a": "shard_0.tar#nobody.text"}\n')
    d = Dataset.from_source("jsonl", str(shards / "refs.jsonl"), RuntimeContext(), spark=spark, schema="a string", ref_fields=[("a", str(shards))])
    with pytest.raises(Exception, match="TarMemberNotFound"):
        d.frame().collect()


def test_standalone_readers(shards):
    assert [r["__index_in_shard__"] for r in readers.iter_tar(str(shards / "shard_0.tar"))] == [0, 1, 2]
    assert [r["value"] for r in readers.iter_jsonls([str(shards / "rows_1.jsonl")])] == [1, 3, 5]
    assert [r["__index_in_file__"] for r in readers.iter_parquets([str(shards / "rows_0.parquet")])] == [0, 1, 2]


def test_tables_with_versions(spark, tmp_path):
    at = str(tmp_path / "t")
    make = lambda a, b: spark.createDataFrame([(i, i * 10) for i in range(a, b)], "k long, v long").coalesce(1)
    table.write(make(0, 5), at, max_rows_per_file=2)
    pinned = table.discover([at])
    table.write(make(5, 8), at, "append")
    assert table.scan(spark, pinned).count() == 5
    src = table.discover([at, at])
    rows = table.scan(spark, src).collect()
    assert sorted(r["__global_index__"] for r in rows) == list(range(16))
    assert all(r["__local_index__"] == r.k for r in rows)
    got = sorted((r["__order__"], r.k) for r in table.take(spark, src, [9, 0, 9]).collect())
    assert got == [(0, 1), (1, 0), (2, 1)]
    (tmp_path / "c.json").write_text(json.dumps({"main_uri": "t", "ref_columns": {"v": {"uri": "t", "key_column": "v", "value_column": "k"}}}))
    d = Dataset.from_source("table", str(tmp_path / "c.json"), RuntimeContext(), spark=spark).resolve_ref("v")
    assert {r.k: r.v for r in d.frame().collect()} == {i: i for i in range(8)}


def test_filters(spark, sf):
    d = _data(spark, sf, "events")
    with pytest.raises(ValueError, match="InvalidLanceFilter"):
        d.filter("no_such_column = 1")
    for bad in ("", [], [1]):
        with pytest.raises(ValueError, match="InvalidLanceFilter"):
            d.filter(bad)
    with pytest.raises(ValueError, match="InvalidFilterPlacement"):
        d.split([1, 1])[0].filter("value > 1")
    assert d.filter("value < -1e9").frame().count() == 0
    plan = _data(spark, sf, "orders", columns=["o_orderkey"]).filter("o_totalprice > 5")._scan()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,5.0)" in plan and "o_orderdate" not in plan


def test_lookup_edges(spark, tmp_path):
    keys = [(0, None), (1, []), (2, ["a", None, "zz"]), (3, [None]), (4, ["b", "a"])]
    spark.createDataFrame(keys, "i int, k array<string>").coalesce(1).write.parquet(str(tmp_path / "m"))
    spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("c", 4), (None, 5)], "key string, value int").write.parquet(str(tmp_path / "r"))
    ref = {"k": {"uri": str(tmp_path / "r"), "key_column": "key", "value_column": "value"}}
    d = Dataset.from_source("table", str(tmp_path / "m"), RuntimeContext(), spark=spark, ref_columns=ref).resolve_ref(["k"])
    assert {r.i: r.k for r in d.frame().collect()} == {0: None, 1: [], 2: [1, None], 3: [], 4: [2, 1]}
    spark.createDataFrame([("c",)], "k string").write.parquet(str(tmp_path / "dup"))
    d = Dataset.from_source("table", str(tmp_path / "dup"), RuntimeContext(), spark=spark, ref_columns=ref).resolve_ref(["k"])
    with pytest.raises(Exception, match="DuplicateLanceRefKey"):
        d.frame().collect()
    with pytest.raises(ValueError, match="UnknownLanceRefColumn"):
        d.resolve_ref(["nobody"])


def test_stages(spark, sf):
    d = _data(spark, sf, "documents", columns=["doc_id", "n_chars"])
    with pytest.raises(ValueError):
        d.batch(0)
    with pytest.raises(ValueError):
        d.shuffle(0)
    a, b = ([r["doc_id"] for r in d.shuffle(50).rows()] for _ in range(2))
    assert a == b and sorted(a) == list(range(200)) and a != sorted(a)
    ragged = d.batch(3, collate_fn=lambda c: {"x": F.transform(c, lambda r: r["doc_id"]), "y": F.array(F.lit(1))}).unbatch()
    with pytest.raises(Exception, match="differ in length"):
        ragged.frame().collect()
    packed = list(d.assemble(Packer, "ids array<long>, size long").rows())
    assert [i for p in packed for i in p["ids"]] == list(range(200))
    dropped = list(d.assemble(Packer, "ids array<long>, size long", drop_last=True).rows())
    assert dropped == packed[:-1]


def test_arrays_survive_a_stage(spark, sf):
    d = _data(spark, sf, "documents", columns=["doc_id"]).map(lambda r: {"doc_id": r["doc_id"], "x": np.full((2, 3), r["doc_id"], np.float32)}, f"doc_id long, x {codecs.TENSOR}")
    first = next(iter(d))
    assert first["x"].shape == (2, 3) and first["x"].dtype == np.float32
    with pytest.raises(RuntimeError, match="InvalidSnapshotTensor"):
        codecs.decode(codecs.encode(np.zeros(3)) | {"shape": "[4]"})


def test_consume_stops_on_false_only(spark, sf):
    class Never(FirstIds):
        def push(self, row):
            super().push(row)

    assert len(_data(spark, sf, "events", columns=["event_id"]).consume(lambda: Never(3))) == 1000


def test_snapshot_is_built_once_in_slot_order(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(7)], "k long").coalesce(1).write.parquet(str(tmp_path / "t"))
    d = Dataset.from_source("table", str(tmp_path / "t"), RuntimeContext(world_size=2), spark=spark)
    conf = CacheConfig(str(tmp_path / "cache"))
    s = d.snapshot(config=conf)
    one = [r["k"] for r in s.at(RuntimeContext()).rows()]
    assert one == [0, 2, 4, 6, 1, 3, 5]
    assert [[r["k"] for r in s.at(RuntimeContext(rank=i, world_size=2)).rows()] for i in (0, 1)] == [[0, 4, 1, 5], [2, 6, 3]]
    (entry,) = grainmill.list_cache_entries(str(tmp_path / "cache"))
    assert entry.kind == "snapshot"
    parts = [{r["k"] for r in p.at(RuntimeContext()).rows()} for p in s.split([0.5, 0.5])]
    assert parts[0] | parts[1] == set(range(7)) and parts[0].isdisjoint(parts[1])
    for f in (tmp_path / "t").glob("*"):
        f.unlink()
    assert [r["k"] for r in s.at(RuntimeContext()).rows()] == one  # the source is gone
    assert grainmill.clear_cache(str(tmp_path / "cache")) == 1


def test_cache_builds_parts_again_after_a_crash(tmp_path):
    m, done = cache.CacheManager(CacheConfig(str(tmp_path))), []

    def build(folder, part):
        if part == "b" and len(done) == 1:
            done.append("crash")
            raise RuntimeError("crash")
        done.append(part)
        (folder / "x").write_text(part)

    src = cache.SourceFingerprint({"a": 1})
    with pytest.raises(RuntimeError, match="crash"):
        m.ensure(src, "k", 1, {}, build, ["a", "b"])
    e = m.ensure(src, "k", 1, {}, build, ["a", "b"])
    assert done == ["a", "crash", "b"] and (e.path / "b" / "x").read_text() == "b"
    (e.path / "a" / "x").write_text("longer")
    assert m.find(src, "k", 1, {}) is None  # a file of another size


def test_resume(spark, sf):
    d = _data(spark, sf, "documents", shuffle_mode="global", columns=["doc_id"]).shuffle(16).batch(7)
    whole = list(d)
    it = iter(d)
    for _ in range(5):
        next(it)
    again = list(d.load_state_dict(json.loads(json.dumps(it.state_dict()))))
    assert again == whole[5:]
    assert iter(d).state_dict()["state"] is None
    with pytest.raises(ResumeStateError, match="ResumeIdentityMismatch"):
        d.shuffle(3).load_state_dict(it.state_dict())
    with pytest.raises(ResumeStateError, match="InvalidResumeStateVersion"):
        d.load_state_dict(it.state_dict() | {"version": 1})


def test_identity():
    f, g = (lambda k: (lambda r: r + k))(1), (lambda k: (lambda r: r + k))(2)
    assert identity.identity(f) != identity.identity(g)
    assert identity.identity({"a": {1, 2}}) == identity.identity({"a": {2, 1}})
    loop = []
    loop.append(loop)
    for bad in (object(), loop, {(1,): 2}):
        with pytest.raises(ResumeStateError):
            identity.identity(bad)


def test_repeated_source_iterates_on(spark, sf):
    d = _data(spark, sf, "region", resample=True, shuffle_mode="global")
    it = iter(d)
    got = [next(it)["r_regionkey"] for _ in range(15)]
    assert all(sorted(got[i : i + 5]) == list(range(5)) for i in (0, 5, 10))
    with pytest.raises(ValueError, match="InfiniteSnapshotSource"):
        d.snapshot()


@pytest.mark.parametrize("folder", ["a b", "a%b", "a+b", "a%20b", "größe", "a#b"])
def test_paths_with_special_characters(spark, tmp_path, folder):
    at = tmp_path / folder
    at.mkdir()
    for i in range(3):
        pq.write_table(pa.table({"x": range(10 * i, 10 * i + 10)}), at / f"{i}.parquet", row_group_size=5)
    (at / "r.jsonl").write_text("\n".join(f'{{"x": {i}}}' for i in range(30)))
    with tarfile.open(at / "s.tar", "w") as tar:
        for i in range(5):
            info = tarfile.TarInfo(f"{i}.x")
            info.size = 1
            tar.addfile(info, io.BytesIO(b"1"))
    files = [str(at / f"{i}.parquet") for i in range(3)]
    c = RuntimeContext()
    assert sorted(r["x"] for r in Dataset.from_source("parquet", files, c)) == list(range(30))
    assert [r["x"] for r in Dataset.from_source("table", files, c)] == list(range(30))
    assert [r["x"] for r in Dataset.from_source("table", str(at / "0.parquet"), c)] == list(range(10))
    assert [r["x"] for r in Dataset.from_source("jsonl", str(at / "r.jsonl"), c, shuffle_mode="none")] == list(range(30))
    assert len(list(Dataset.from_source("tar", str(at / "s.tar"), c, fields=["x"]))) == 5


def _numbers(tmp_path, n=30, files=6):
    for i in range(files):
        pq.write_table(pa.table({"x": range(n // files * i, n // files * (i + 1))}), tmp_path / f"{i}.parquet")
    return [str(tmp_path / f"{i}.parquet") for i in range(files)]


@pytest.mark.parametrize("kind", ["parquet", "table"])
@pytest.mark.parametrize("stage", ["none", "map", "shuffle", "batch", "assemble"])
def test_endless_reads_go_over_the_ends_of_rounds(spark, tmp_path, kind, stage):
    at = _numbers(tmp_path)

    def build():
        d = Dataset.from_source(kind, at, RuntimeContext(rank=1, world_size=2, seed=3), True, **({"shuffle_mode": "global"} if kind == "table" else {}))
        return {"none": lambda: d, "map": lambda: d.map({"x": "x + 1"}), "shuffle": lambda: d.shuffle(8), "batch": lambda: d.batch(4), "assemble": lambda: d.assemble(_Pairs, "a long, b long")}[stage]()

    take = lambda it, n: [next(it) for _ in range(n)]
    n = {"batch": 18, "assemble": 34}.get(stage, 70)
    whole = take(iter(build()), n)
    rounds = list(build().rows(8, ends=False))  # 8 rounds of 15 rows each, in one go
    assert whole == rounds[:n] and len(rounds) >= n
    it = iter(build())
    first = take(it, n // 2)
    state = json.loads(json.dumps(it.state_dict()))
    assert first + take(iter(build().load_state_dict(state)), n - len(first)) == whole
    other = iter(build())
    other.load_state_dict(it.live_state())
    assert take(other, n - len(first)) == whole[len(first) :]


class _Pairs:
    def __init__(self):
        self.held = []

    def push(self, row):
        self.held.append(row["x"])
        if len(self.held) == 2:
            a, b = self.held
            self.held = []
            yield {"a": a, "b": b}

    def finish(self, *, drop_last=False):
        return [] if drop_last or not self.held else [{"a": self.held[0], "b": None}]


def test_a_rank_reads_its_own_files(spark, tmp_path):
    at = _numbers(tmp_path)
    d = Dataset.from_source("parquet", at, RuntimeContext(rank=1, world_size=3), shuffle_mode="none")
    assert len(d.frame(slot=1).inputFiles()) == 2 and len(d.frame().inputFiles()) == 6
    assert [r["x"] for r in d] == [*range(5, 10), *range(20, 25)]
    assert len(d.frame(slot=1, start=7).inputFiles()) == 1  # what comes before a resumed place is not read
    assert [r["x"] for r in d.rows(1, 7)] == [22, 23, 24]
    t = Dataset.from_source("table", at, RuntimeContext())
    half = t.split([0.5, 0.5])[1]
    assert len(half.frame().inputFiles()) == 3 and [r["x"] for r in half] == list(range(15, 30))


def test_state_of_a_dataset(spark, tmp_path):
    d = Dataset.from_source("table", _numbers(tmp_path), RuntimeContext())
    assert d.state_dict()["state"] is None
    it = iter(d)
    first = [next(it) for _ in range(3)]
    state = d.state_dict()
    rest = list(it)
    assert d.state_dict()["state"] is None  # it is over
    d.load_state_dict(state)
    assert list(d) == rest and list(d) == first + rest
    with pytest.raises(ResumeStateError, match="InvalidResumeState"):
        iter(d).load_state_dict(d.state_dict())
    for bad in ({}, {"yielded": -1}, {"yielded": "x"}, {"yielded": 1, "identity": {}}, None):
        with pytest.raises(ResumeStateError, match="InvalidResumeState"):
            iter(d).load_state_dict(bad)


def test_loader(spark, sf):
    d = _data(spark, sf, "events", columns=["event_id"])
    with pytest.raises(ValueError):
        Loader(d, num_workers=-1)
    with pytest.raises(ValueError):
        Loader(d, drop_last=True)
    with pytest.raises(TypeError):
        Loader("x")
    # 1000 rows by three workers in batches of 100: worker 0 has 334, the others 333
    sizes = [len(b["items"]) for b in Loader(d, num_workers=3, batch_size=100)]
    assert sizes == [100] * 9 + [34, 33, 33]
    ids = [r["event_id"] for r in Loader(d, num_workers=3).shuffle(20)]
    assert sorted(ids) == list(range(1000)) and ids != sorted(ids)
    with pytest.raises(ValueError):
        loading.balance(d.frame(), ranks=2, drop_last=False)


def test_loader_resumes(spark, sf):
    def build(size=16):
        return Loader(_data(spark, sf, "events", columns=["event_id"]), num_workers=3, batch_size=size).unbatch().shuffle(20).batch(7)

    whole = list(build())
    loader = build()
    it = iter(loader)
    first = [next(it) for _ in range(40)]
    for state in (it.state_dict(), loader.state_dict()):
        assert first + list(build().load_state_dict(json.loads(json.dumps(state)))) == whole
    assert build().state_dict()["state"] is None
    rest = list(it)
    assert first + rest == whole and it.state_dict()["state"] is None
    with pytest.raises(ResumeStateError, match="ResumeIdentityMismatch"):
        build(17).load_state_dict(loader.state_dict())


@pytest.mark.parametrize("drop", [True, False])
def test_balance_is_a_stage_of_the_loader(spark, tmp_path, drop):
    files = []
    for i, n in enumerate((50, 9, 20)):
        pq.write_table(pa.table({"x": range(100 * i, 100 * i + n)}), tmp_path / f"{i}.parquet")
        files.append(str(tmp_path / f"{i}.parquet"))
    got = []
    for r in range(3):
        d = Dataset.from_source("parquet", files, RuntimeContext(rank=r, world_size=3, local_rank=r, local_world_size=3), shuffle_mode="none", columns=["x"])
        made = Loader(d).balance(drop_last=drop, dummy_factory=None if drop else lambda: {"x": -1}, buffer_size=4, chunk_size=4)
        got.append([b["n"] for b in made.map({"n": "x"})])
        with pytest.raises(loading.UnsupportedResumeError):
            made.state_dict()
    assert len({len(g) for g in got}) == 1
    rows = sorted(x for g in got for x in g if x >= 0)
    assert len(set(rows)) == len(rows)
    assert len(rows) == 79 if not drop else 79 - len(rows) < 3
    assert got[0][:8] == list(range(8))  # each rank begins with its own


def test_parquet_batch_size(monkeypatch, spark, tmp_path):
    at = _numbers(tmp_path)[0]
    monkeypatch.setenv("GRAINMILL_PARQUET_BATCH_SIZE", "2")
    assert readers.parquet_batch_size() == 2 and readers.parquet_batch_size(9) == 9
    assert [r["x"] for r in readers.iter_parquet(at)] == list(range(5))
    for bad in ("0", "x", "-1", ""):
        monkeypatch.setenv("GRAINMILL_PARQUET_BATCH_SIZE", bad)
        with pytest.raises(ValueError, match="InvalidParquetBatchSize"):
            list(readers.iter_parquet(at))


def test_context_asks_torch_if_the_program_has_it(monkeypatch):
    from types import SimpleNamespace as N

    group = N(is_available=lambda: True, is_initialized=lambda: True, get_rank=lambda: 3, get_world_size=lambda: 8)
    monkeypatch.setitem(sys.modules, "torch", N(distributed=group, utils=N(data=N(get_worker_info=lambda: N(id=1, num_workers=4)))))
    c = RuntimeContext.from_runtime()
    assert (c.rank, c.world_size, c.worker_id, c.num_workers) == (3, 8, 1, 4)


def test_stream_goes_on_where_it_was(spark, sf, tmp_path):
    d = _data(spark, sf, "supplier", 2, resample=True, shuffle_mode="global", columns=["s_suppkey"])
    assert d.source.rows == 10

    def run():
        f = streaming.stream(d, rows_per_batch=15, partitions=2)
        q = f.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out"))

    first = run().count()
    rows = run().select("s_suppkey", SLOT, ROUND, POS).collect()
    assert len(rows) > first and len({(r[SLOT], r[POS]) for r in rows}) == len(rows)
    want = {(r[SLOT], r[POS]): r.s_suppkey for r in d.frame(len(rows) // 10 + 1).collect()}
    assert all(want[r[SLOT], r[POS]] == r.s_suppkey for r in rows)
    with pytest.raises(ValueError, match="UnsupportedStream"):
        streaming.stream(d.batch(2))


def test_streamed_assembly_keeps_its_state(spark, tmp_path):
    src = tmp_path / "src"
    schema = f"{SLOT} int, {ROUND} int, {POS} long, doc_id long, n_chars long"
    parts = [[(0, 0, i, i, 900) for i in range(a, a + 6)] for a in (0, 6)]
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(src))
        df = spark.readStream.schema(schema).parquet(str(src))
        q = streaming.assemble(df, Packer, "ids array<long>, size long").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted(r.ids for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [[0, 1, 2, 3], [4, 5, 6, 7]]  # the last pack is still open


def test_logging():
    grainmill.set_log_level("debug")
    assert grainmill.get_log_level() == 10
    grainmill.reset_log_level()
    with pytest.raises(TypeError):
        grainmill.set_logger(object())
    with pytest.raises(ValueError):
        grainmill.set_log_level("loud")
    assert grainmill.get_logger().name == "grainmill"
