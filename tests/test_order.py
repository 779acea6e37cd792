"""Permutations, orders, parts and merges: invariants and brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grainmill.functions.permute import mix_seed, permute
from grainmill.operators import balance, mixing, order, stages, subset
from grainmill.operators.balance import RankStatus, Transfer
from grainmill.plans.context import DataLoadMesh, RuntimeContext
from grainmill.plans.dataset import Dataset
from grainmill.plans.queries import _data, _mix, _units
from grainmill.operators.order import POS, SLOT


@pytest.mark.parametrize("n", [1, 2, 7, 8, 100, 1000])
@pytest.mark.parametrize("seed", [0, 42, 2**63 + 5])
def test_permutation_is_a_bijection_and_inverts(n, seed):
    x = np.arange(n)
    y = permute(x, n, seed)
    assert sorted(y) == list(range(n))
    assert (permute(y, n, seed, back=True) == x).all()


def test_permutation_refuses_what_is_out_of_range():
    with pytest.raises(ValueError):
        permute(np.array([5]), 5, 1)
    assert mix_seed(1, 2) != mix_seed(2, 1)


@given(st.integers(1, 200), st.integers(1, 30), st.integers(1, 5), st.sampled_from(["permuted", "sequential"]), st.integers(0, 9))
@settings(max_examples=80, deadline=None)
def test_chunk_shuffle_is_a_permutation(total, size, k, rows, seed):
    c = order.ChunkShuffle(size, k, rows)
    at = c.places(np.arange(total), total, seed, 0)
    assert sorted(at) == list(range(total))
    if rows == "sequential":
        inv = np.argsort(at)
        runs = np.split(inv, np.flatnonzero(np.diff(inv) != 1) + 1)
        assert all(r[0] % size == 0 for r in runs)


def test_chunk_shuffle_arguments():
    for bad in ({"chunk_size": 0}, {"k": True}, {"row_order": "x"}, {"size": 3}):
        with pytest.raises(ValueError, match="InvalidLanceChunkShuffle"):
            order.ChunkShuffle.of(bad)


def _interleave(strategy, counts, weights, seed):
    """Row by row, as cursors would do it."""
    left, alive, out = list(counts), list(range(len(counts))), []
    current, turn, rng = [0] * len(counts), 0, random.Random(seed)
    while alive:
        if strategy == "concat":
            i = alive[0]
        elif strategy == "round_robin":
            i = alive[turn % len(alive)]
        else:
            for a in alive:
                current[a] += weights[a]
            i = max(alive, key=lambda a: current[a])
            current[i] -= sum(weights[a] for a in alive)
        if not left[i]:
            at = alive.index(i)
            alive.remove(i)
            turn = at % len(alive) if alive else 0
            continue
        out.append((i, counts[i] - left[i]))
        left[i] -= 1
        turn = (alive.index(i) + 1) if strategy == "round_robin" else turn
    return out


@given(st.lists(st.integers(0, 25), min_size=1, max_size=4), st.data(), st.sampled_from(["concat", "round_robin", "weighted_round_robin"]))
@settings(max_examples=150, deadline=None)
def test_merge_places_match_cursors(counts, data, strategy):
    weights = [data.draw(st.integers(1, 5)) for _ in counts]
    want = _interleave(strategy, counts, weights, 0)
    got = {}
    for s, n in enumerate(counts):
        for nth, place in enumerate(mixing.places(strategy, counts, weights, s, np.arange(n), 0)):
            got[int(place)] = (s, nth)
    assert [got[i] for i in range(sum(counts))] == want


def test_golden_merges():
    for strategy, want in (("concat", "AAAABB"), ("round_robin", "ABABAA"), ("weighted_round_robin", "ABAABA")):
        at = {int(p): c for s, c in enumerate("AB") for p in mixing.places(strategy, (4, 2), (2, 1), s, np.arange((4, 2)[s]), 0)}
        assert "".join(at[i] for i in range(6)) == want


def test_random_merges_use_every_row_once():
    for w in (None, (2, 1)):
        p = list(mixing.random_picks((40, 25), w, 11))
        assert p == list(mixing.random_picks((40, 25), w, 11)) and np.bincount(p).tolist() == [40, 25]
        rows = [x for s, n, at in mixing.schedule((40, 25), w, 11, 9) for x in zip(s, n, at)]
        assert [s for s, _, _ in rows] == p and [a for _, _, a in rows] == list(range(65))
        assert all([n for s, n, _ in rows if s == i] == list(range(c)) for i, c in enumerate((40, 25)))


def _buffer(count, size, initial, seed):
    """The buffer, written out: fill up to two rows a turn, give one out once enough are held, then drain."""
    rng, src, held, out = random.Random(seed), iter(range(count)), [], []
    start = min(size, initial or size)

    def give():
        i = rng.randrange(len(held))
        held[i], held[-1] = held[-1], held[i]
        out.append(held.pop())

    for x in src:
        held.append(x)
        if len(held) < size:
            nxt = next(src, None)
            if nxt is not None:
                held.append(nxt)
        if len(held) >= start:
            give()
    while held:
        give()
    return out


@given(st.integers(0, 60), st.integers(1, 20), st.one_of(st.none(), st.integers(1, 20)), st.integers(0, 5))
@settings(max_examples=150, deadline=None)
def test_reservoir(count, size, initial, seed):
    got = list(stages.reservoir(count, size, initial, seed))
    # rows that come after don't change what is given out before they are needed
    more = list(stages.reservoir(count + 7, size, initial, seed))
    first = list(stages.reservoir(count, size, initial, seed, ends=False))
    assert more[: len(first)] == first and len(first) >= count - size - 1
    assert sorted(got) == list(range(count))
    assert got == _buffer(count, size, initial, seed)


# -- parts -----------------------------------------------------------------------------------------------------------


def test_cuts_and_units():
    assert subset.cuts(10, [1, 1]) == [0, 5, 10]
    assert subset.cuts(5, [0.5, 0.5]) == [0, 2, 5]  # half to even
    assert subset.split_units([1] * 4, [0.5, 0.5]) == [[0, 1], [2, 3]]
    assert subset.split_units([10, 1, 1], [0.5, 0.5]) == [[0], [1, 2]]
    s = subset.sample_units([1] * 20, 0.3, 7)
    assert len(s) == 6 and s == sorted(s) and s == subset.sample_units([1] * 20, 0.3, 7)
    for bad in ([], [0, 1], [float("inf")]):
        with pytest.raises(ValueError, match="InvalidSplitFractions"):
            subset.cuts(5, bad)
    for bad in (0, 1.5, float("nan")):
        with pytest.raises(ValueError, match="InvalidSampleFraction"):
            subset.check_fraction(bad)


@pytest.mark.parametrize("mode", ["none", "global", "chunk"])
def test_parts_are_disjoint_and_whole(spark, sf, mode):
    d = _data(spark, sf, "documents", 2, shuffle_mode=mode)
    parts = [{r.doc_id for r in p.dataframe().select("doc_id").collect()} for p in d.split([0.6, 0.4])]
    assert parts[0].isdisjoint(parts[1]) and parts[0] | parts[1] == set(range(200))
    assert [len(p) for p in parts] == [120, 80]


@pytest.mark.parametrize("mode", ["none", "global", "chunk"])
def test_sample_members_are_the_same_in_every_round(spark, sf, mode):
    d = _data(spark, sf, "documents", 2, shuffle_mode=mode).sample(0.25, 3)
    rows = d.frame(3).select("doc_id", "__round__", SLOT, POS).collect()
    by = {r: sorted(x.doc_id for x in rows if x["__round__"] == r) for r in range(3)}
    assert by[0] == by[1] == by[2] and len(by[0]) == 50
    for s in (0, 1):
        assert sorted(x[POS] for x in rows if x[SLOT] == s) == list(range(75))
    if mode == "global":
        assert [x.doc_id for x in sorted(rows, key=lambda x: (x["__round__"], x[POS], x[SLOT]))][:50] != by[0]


def test_all_slots_together_read_all(spark, sf):
    for d in (_data(spark, sf, "events", 3, shuffle_mode="global"), _units(spark, sf, "pages", "page_id", 3)):
        rows = d.frame().select(SLOT, POS, d.frame().columns[0]).collect()
        assert len({r[2] for r in rows}) == len(rows)
        for s in range(3):
            at = sorted(r[POS] for r in rows if r[SLOT] == s)
            assert at == list(range(len(at)))


def test_too_few_units(spark, sf):
    with pytest.raises(ValueError, match="InsufficientSubsetUnits"):
        _units(spark, sf, "pages", "page_id", 2).split([0.8, 0.2])


def test_random_mix_is_its_schedule(spark, sf):
    rows = sorted(_mix(spark, sf, "random").collect(), key=lambda r: r.pos)
    picks = mixing.random_picks((40, 10), None, 42)
    assert [r.source for r in rows] == ["ab"[i] for i in picks]
    assert [r.id for r in rows if r.source == "a"] == list(range(40))


# -- balance ---------------------------------------------------------------------------------------------------------


def _plan(have, nodes=None, **kw):
    s = [RankStatus(r, (nodes or [0] * len(have))[r], r, n) for r, n in enumerate(have)]
    return balance.plan(s, **({"chunk_size": 2, "max_transfer": 16, "drop_last": True} | kw))


def test_balance_goldens():
    p = _plan([2, 2])
    assert p.local_take == {0: 2, 1: 2} and not p.transfers
    p = _plan([4, 0, 4, 0], [0, 0, 1, 1], chunk_size=1)
    assert p.transfers == [Transfer(0, 1, 1), Transfer(2, 3, 1)]
    p = _plan([0, 0, 4, 1], [0, 0, 1, 1], chunk_size=1)
    assert p.transfers == [Transfer(2, 0, 1), Transfer(2, 1, 1)]
    p = _plan([10, 0], chunk_size=4, max_transfer=2)
    assert p.local_take == {0: 2, 1: 0} and sum(t.count for t in p.transfers) == 2
    assert _plan([1, 0]).local_take == {0: 0, 1: 0}
    p = _plan([1, 0], drop_last=False)
    assert p.local_take == {0: 1, 1: 0} and p.dummies == {0: 0, 1: 1}
    p = _plan([3] + [0] * 7, chunk_size=4, drop_last=False)
    assert p.local_take[0] == 3 and [p.dummies[r] for r in range(1, 8)] == [3] * 7
    with pytest.raises(ValueError, match="too small"):
        _plan([5, 0, 0], max_transfer=1)


@given(st.lists(st.integers(0, 60), min_size=2, max_size=5), st.booleans())
@settings(max_examples=80, deadline=None)
def test_balanced_ranks_have_as_many(counts, drop):
    runs, dummies = balance.schedule(dict(enumerate(counts)), chunk_size=4, max_transfer=16, drop_last=drop)
    n = dict(dummies)
    for _, _, k, to in runs:
        n[to] += k
    assert len(set(n.values())) == 1
    taken = sum(k for _, _, k, _ in runs)
    assert taken == sum(counts) if not drop else sum(counts) - taken < len(counts)


# -- context ---------------------------------------------------------------------------------------------------------


class Mesh:
    mesh_dim_names = ("dp", "fsdp", "tp")
    sizes, at = (2, 3, 4), (1, 2, 0)

    def size(self, i):
        return self.sizes[i]

    def get_local_rank(self, i):
        return self.at[i]


def test_slots_of_meshes_and_ranks():
    m = DataLoadMesh(Mesh(), ("dp", "fsdp"))
    assert (m.dp_rank, m.dp_size, m.is_dp_leader) == (5, 6, True)
    c = RuntimeContext(mesh=m, worker_id=1, num_workers=2)
    assert (c.slot, c.total_slots) == (11, 12)
    c = RuntimeContext.from_runtime(env={"RANK": "3", "WORLD_SIZE": "8", "LOCAL_WORLD_SIZE": "4", "WORKER": "1", "NUM_WORKERS": "2"})
    assert (c.slot, c.total_slots, c.node_rank) == (7, 16, 0)
    for bad in ({"rank": 1}, {"world_size": 0}, {"worker_id": 2, "num_workers": 2}):
        with pytest.raises(ValueError):
            RuntimeContext(**bad)
    with pytest.raises(ValueError):
        DataLoadMesh(Mesh(), "pp")


def test_sources_that_are_none(spark):
    with pytest.raises(ValueError, match="UnsupportedSourceKind"):
        Dataset.from_source("csv", "x", RuntimeContext(), spark=spark)


def test_file_barrier(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from grainmill.plans.barrier import FileBarrier

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda r: FileBarrier(str(tmp_path), r, 3, 20).wait("start"), range(3)))
    with pytest.raises(TimeoutError, match=r"\[1\]"):
        FileBarrier(str(tmp_path), 0, 2, 0.2).wait("alone")
    with pytest.raises(ValueError):
        FileBarrier(str(tmp_path), 2, 2)


def test_bounded_shuffle_sorts_in_all_parts(spark):
    df = spark.range(90).selectExpr(f"cast(id % 2 as int) AS {SLOT}", "0 AS __round__", f"id div 2 AS {POS}", "id")
    out = stages.shuffle(df, 3, 2, 11)
    assert sorted((r[SLOT], r[POS], r.id) for r in out.collect()) == [(s, to, 2 * x + s) for s in (0, 1) for to, x in enumerate(stages.reservoir(45, 3, 2, 11 + s))]
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
