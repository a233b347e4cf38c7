import random

import numpy as np
import pytest

from stratagrid.llm import graph
from stratagrid.llm import near_dedup as op

from . import helpers as h


def brute(rows, percent=85):
    sets = []
    for _, t in rows:
        w = h.blank_words(h.lower((t or "").encode()).decode())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = h.union_find(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(least.get(root[k], i), i)
    return sorted((i, len(sets[k]), least[root[k]], i == least[root[k]]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("limits", [{}, {"block": 300}, {"block": 40}])
def test_equals_brute_force(spark, limits):
    rows = h.corpus(3)
    got = op.near_duplicates(h.table(spark, rows), **limits).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_empty_table(spark):
    assert op.near_duplicates(h.table(spark, [])).collect() == []


def test_null_ids(spark):
    got = op.near_duplicates(h.table(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (None, None), (5, "q r s t u v")])).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == sorted([(None, 2, None, True), (None, 2, None, True), (None, 0, None, True), (5, 2, 5, True)], key=str)
    assert len({r.group_key for r in got if r.doc_id is None and r.n_shingles}) == 1


def test_groups_are_exact():
    rng = random.Random(2)
    sets = []
    for _ in range(12):
        base = rng.sample(range(100_000), 60)
        for cut in range(5):
            sets.append(np.array(sorted(base[cut * 2 :] + rng.sample(range(100_000, 200_000), cut)), np.uint64))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(x := np.intersect1d(sets[a], sets[b])) >= 85 * (len(sets[a]) + len(sets[b]) - len(x))]
    want = h.union_find(range(len(sets)), links)
    assert op.link_groups(sets, 85).tolist() == [want[i] for i in range(len(sets))]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == h.union_find(nodes, [e for e in edges if e[0] != e[1]])


def variants(seed, changed, picks):
    """A page template of 300 shingles, and those variants with one changed passage whose numbers are in picks."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**9)}" for _ in range(304)]
    cuts = [rng.randrange(20, 294 - changed) for _ in range(max(picks) + 1)]
    return base, [" ".join(base[: cuts[k]] + [f"v{k}x{q}" for q in range(changed)] + base[cuts[k] + changed :]) for k in picks]


@pytest.mark.parametrize("block", [4_000_000, 9_000])
@pytest.mark.parametrize(("percent", "changed", "picks"), [(85, 17, [318, 831, 2105]), (80, 26, [30, 34, 61])])
def test_variants_of_a_crowded_template(spark, percent, changed, picks, block):
    # 200 distinct texts in a region, and variants at 0.852 (0.802) to each that share four minima with them, but not six or eight
    base, edge = variants(1, changed, picks)
    texts = [" ".join([*base[:2], f"slot{k}", *base[3:]]) for k in range(200)] + edge
    got = op.near_duplicates(h.table(spark, list(enumerate(texts))), percent=percent, block=block).collect()
    assert [r.doc_id for r in got if r.component_id != 0] == [] and len(got) == len(texts)


def test_orders_follow_the_similarity(spark):
    # 16 orders, enough at 0.85, miss this pair at 0.802
    base, edge = variants(5, 26, [7004])
    got = op.near_duplicates(h.table(spark, [(1, " ".join([*base[:2], "slot0", *base[3:]])), (2, edge[0])]), percent=80).collect()
    assert [r.component_id for r in got] == [1, 1]
    assert all((1 - (p / 100) ** op.DEPTH) ** op.orders(p) <= op.MISSED for p in (50, 80, 85, 99)) and op.orders(85) == 16 and op.orders(100) == 1


def test_work_on_a_chain_is_linear(spark, monkeypatch):
    """Texts that are similar one to the next make one cluster, but regions of a few: rows compared grow as the chain."""
    seen = []
    compared = op.compared
    monkeypatch.setattr(op, "compared", lambda tasks, *rest: seen.append(tasks.count()) or compared(tasks, *rest))
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**9)}" for _ in range(3 * 400 + 200)]
    rows = []
    for n in (100, 400):
        seen.append(0)
        texts = [(i, " ".join(words[3 * i : 3 * i + 120])) for i in range(n)]
        got = op.near_duplicates(h.table(spark, texts), block=5_000).collect()
        assert {r.component_id for r in got} == {0} and len(got) == n
        rows.append(sum(seen[seen.index(0) :]))
        seen.clear()
    assert rows[1] < 6 * rows[0]


def test_the_same_row_many_times(spark, monkeypatch):
    from stratagrid.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    near = " ".join(f"w{i}" for i in range(100))
    rows = [(1, near)] * 60 + [(2, near + " end")] * 40 + [(3, "something else in here now")] * 2
    got = op.near_duplicates(h.table(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute(rows)
