import random
import re

from stratagrid.llm import decontaminate as op

from . import helpers as h


def words(text):
    return [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", h.lower((text or "").encode()))]


def brute(rows, items):
    cut = []
    for i, t in items:
        w = words(t)
        cut += [(i, tuple(w[k : k + 10])) for k in range(max(1, len(w) - 9))] if w else []
    out = []
    for d, t in rows:
        w, hit, names = words(t), set(), set()
        for i, x in cut:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    names.add(str(i))
        out.append((d, len(w), len(hit), sorted(names), bool(hit)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    long, short = h.prose(rng, 30), "Zwei Wörter, 3x"
    items = [(1, long), (2, short), (10, long + " more"), (3, ""), (4, None), (5, "..."), (6, "solo")]
    w = long.split()
    rows = h.corpus(6) + [(500, "x " + long.upper() + ", y"), (501, " ".join(w[3:13])), (502, " ".join(w[3:12])), (503, "ZWEI wörter; 3X zwei Wörter 3x"), (504, " ".join([*w[:5], "extra", *w[5:]])), (505, "solo solo")]
    got = op.decontaminate(h.table(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=str) == brute(rows, items)
    assert next(r.n_near for r in got if r.doc_id == 504) > 0


def test_copies_and_frequent_short_items(spark, monkeypatch):
    from stratagrid.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    monkeypatch.setattr(op, "BROADCAST_BYTES", 10)
    items = [(1, "solo"), (2, "solo"), (3, "two words")]
    rows = [(i, "solo two words " * 40) for i in range(30)] + [(100, "solo " * 5000), (101, None), (101, None)]
    got = op.decontaminate(h.table(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=str) == brute(rows, items)


def test_shuffled_when_large(spark):
    rows, items = [(1, "a b c d"), (2, "b c")], [(1, "b c")]
    got = op.decontaminate(h.table(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), broadcast_rows=0).collect()
    assert sorted((r.doc_id, r.n_hit) for r in got) == [(1, 2), (2, 2)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert op.decontaminate(h.table(spark, []), none).collect() == []
    assert [r.contaminated for r in op.decontaminate(h.table(spark, [(1, "a")]), none).collect()] == [False]
