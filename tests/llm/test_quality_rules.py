import re

from stratagrid.llm import quality_rules as op

from . import helpers as h


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = h.windows(w, 5)
    hit = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(hit)


def test_measures_equal_brute_force(spark):
    rows = h.corpus(7) + [(600, "a b c d e a b c d e f"), (601, "a a a a a a"), (602, "x|y #1 <b>\n\nx\n x\nx\n"), (603, "héé 😀 \u00a0 z"), (604, "1 2 3 4 5 " * 3 + "9 1 2 3 4 5")]
    got = op.ledger(h.table(spark, rows)).collect()
    assert sorted((r.doc_id, *(r[m] for m in op.MEASURES)) for r in got) == sorted((i, *brute(t)) for i, t in rows)
    for r in got:
        assert bool(r.failures & op.BIT["too_few_words"]) == (r.n_words < 10)
        assert bool(r.failures & op.BIT["repeated_phrases"]) == (100 * r.n_repeat_words > 20 * r.n_words)


def test_policies_and_ablation(spark):
    held = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "failures bigint")
    assert sorted(r[0] for r in held.where(op.passes("base")).collect()) == [0, 4]
    assert sorted(r[0] for r in held.where(op.passes(4)).collect()) == [0, 1, 1, 3]
    out = {r.rule: (r.texts, r.failed, r["only"], r.kept_without) for r in op.ablation(held, "base").collect()}
    assert out["too_few_words"] == (5, 3, 2, 4) and out["repeated_phrases"] == (5, 1, 0, 2)
    assert set(out) == {"too_few_words", "repeated_phrases"}


def test_empty_table(spark):
    assert op.ledger(h.table(spark, [])).collect() == []
