import hashlib
from collections import Counter

import numpy as np
import pytest

from stratagrid.llm import substring_dedup as op

from . import helpers as h


def brute(rows, window):
    words = [h.blank_words(t) for _, t in rows]
    seen = Counter()
    for w in words:
        seen.update(h.windows(w, window))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {k for j in range(len(w) - window + 1) if seen[tuple(w[j : j + window])] > 1 for k in range(j, j + window)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"group": 40, "subtree": 50}, {"group": 500, "subtree": 7}])
def test_equals_brute_force(spark, limits):
    rows = h.corpus()
    got = op.substring_dedup(h.table(spark, rows), **limits).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute(rows, 35)


def test_text_and_extra_columns(spark):
    rows = [(1, "a  b\n" + "c d " * 3), (2, None), (3, "x y")]
    got = {r.doc_id: r for r in op.substring_dedup(h.table(spark, rows), window=4, carry=["doc_id", "row", "n_words"][:2], want_text=True).collect()}
    assert got[1].kept_text == "a b" and got[1].n_removed == 6
    assert got[2].kept_text is None and got[2].n_words == 0
    assert got[3].kept_text == "x y" and got[3].row == 7


def test_empty_table(spark):
    assert op.substring_dedup(h.table(spark, [])).collect() == []


def test_variants_of_a_sentence_are_no_repeats(spark):
    # 10,000 sentences that differ in one word only, among them words whose 32-bit hashes are equal
    sentence = [f"word{i}" for i in range(40)]
    names = [f"id{i}" for i in (255970, 242659, 102000, 61646, 394909, 135761, *range(10_000))]
    rows = [(i, " ".join([*sentence[:20], x, *sentence[21:]])) for i, x in enumerate(names)]
    got = op.substring_dedup(h.table(spark, rows, extra=False), window=38).agg({"n_removed": "sum"}).head()[0]
    assert got == 0
    rows = [*rows, (20_000, rows[5][1]), (20_001, "other " + rows[7][1] + " other")]
    got = op.substring_dedup(h.table(spark, rows, extra=False)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute(rows, 35)


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    real = op.tx.word_hashes
    monkeypatch.setattr(op.tx, "word_hashes", lambda *a: real(*a) & np.uint64(7))
    rng = __import__("random").Random(2)
    base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(30)]
    segments = []
    for _ in range(60):
        words = list(base)
        words[rng.randrange(30)] = rng.choice("abcdefgh") * 2
        segments.append(words[rng.randrange(10) :])
    raw = [" ".join(x).encode() for x in segments]
    off = np.append(0, np.cumsum([len(x) for x in raw]))
    seg, place = op.repeats(np.frombuffer(b"".join(raw), np.uint8), off, 12)
    seen = Counter(tuple(x[i : i + 12]) for x in segments for i in range(len(x) - 11))
    assert list(zip(seg.tolist(), place.tolist(), strict=True)) == [(k, i) for k, x in enumerate(segments) for i in range(len(x) - 11) if seen[tuple(x[i : i + 12])] > 1]


def test_long_words_and_gaps(spark):
    rng = __import__("random").Random(3)
    long = ["".join(rng.choice("abcdeé") for _ in range(n)) for n in (63, 64, 65, 66, 500, 100_000)]
    body = (" \n\t" * 30).join([*long, *"abcdefgh"] * 6)
    rows = [(1, body), (2, "  " + " ".join([*long, *"abcdefgh"] * 6)), (3, body.replace("aa", "ab")), (4, " ".join(long[::-1] * 8) + "\x0b"), (5, " " * 5000), (6, "x" * 10**6)]
    got = op.substring_dedup(h.table(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute(rows, 35)


def test_copies_of_a_text_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(op.shared, "HOT_ROWS", 3)
    rows = [*h.corpus(4), *[(500, None)] * 9, *[(600 + i, "one two three " * 20) for i in range(11)]]
    got = op.substring_dedup(h.table(spark, rows), group=40).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows, 35), key=str)


def test_nodes_with_colliding_prefixes():
    words = np.array([1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 7, 1, 2, 3, 4, 5, 6], np.uint32)
    assert op.deep_nodes(words, np.array([0, 6, 12]), 6).tolist() == [True, False, True]
    assert op.deep_nodes(words, np.array([0, 6, 12]), 6, subtree=1).tolist() == [True, False, True]
