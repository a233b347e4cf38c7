import random

from stratagrid.llm import license_scan as op

from . import helpers as h


def plain(a, b):
    """Patience alignment by the book, recursively."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if i:
        return [(k, k) for k in range(i)] + [(x + i, y + i) for x, y in plain(a[i:], b[i:])]
    j = 0
    while j < min(len(a), len(b)) and a[len(a) - 1 - j] == b[len(b) - 1 - j]:
        j += 1
    if j:
        return plain(a[: len(a) - j], b[: len(b) - j]) + [(len(a) - j + k, len(b) - j + k) for k in range(j)]
    once = [(a.index(x), b.index(x)) for x in a if a.count(x) == 1 and b.count(x) == 1]
    best = []
    for k, (_, y) in enumerate(once):
        runs = [best[m] for m in range(k) if once[m][1] < y]
        best.append(max(runs, key=len, default=[]) + [once[k]])
    run = max(best, key=len, default=[])
    if not run:
        return []
    out, (x, y) = list(run), (-1, -1)
    for u, v in [*run, (len(a), len(b))]:
        out += [(x + 1 + p, y + 1 + q) for p, q in plain(a[x + 1 : u], b[y + 1 : v])]
        x, y = u, v
    return sorted(out)


def test_alignment_matches_the_plain_one():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randrange(12) for _ in range(rng.randrange(14))]
        b = [x for x in a if rng.random() < 0.8] + [rng.randrange(12) for _ in range(rng.randrange(4))]
        got = op.matches(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x < u and y < v for (x, y), (u, v) in zip(got, got[1:], strict=False))
        assert len(got) == len(plain(a, b))


def words_of(text):
    return op._hashes(*op.tx.buffers(op.pa.array([text])))[0].tolist()


def every_start(words, text, least):
    """Finds from left to right, with an alignment at each start."""
    out, s, width = [], 0, len(words) + (len(words) + 1) // 2
    while s < len(text):
        pairs = plain(words, text[s : s + width]) if text[s] in words else []
        if len(pairs) < least * len(words) - 1e-9:
            s += 1
            continue
        while pairs[0][1]:
            better = plain(words, text[s + pairs[0][1] : s + pairs[0][1] + width])
            if len(better) <= len(pairs):
                break
            s, pairs = s + pairs[0][1], better
        out.append((len(pairs), s + pairs[0][1], s + pairs[-1][1] + 1))
        s = out[-1][2]
    return out


def brute(bodies, text, least):
    found = [(name, n / len(w), n, s, e) for name, w in bodies.items() for n, s, e in every_start(w, text, least)]
    found = [f for f in found if not any(g[3] <= f[3] and f[4] <= g[4] and g[2] > f[2] for g in found)]
    return sorted(found, key=lambda f: (f[3], f[4], f[0]))


SHORT = {"one": "permission to use and copy this work is granted to all who keep this notice in it", "two": "licensed under the plain license version two", "three": "licensed under the plain license version two the license says that you may not use this work except in compliance with it"}


def test_scan_equals_every_start(spark):
    rng = random.Random(6)
    rows = []
    for k in range(60):
        text = []
        for _ in range(rng.randint(1, 4)):
            text += h.prose(rng, rng.randint(0, 12)).split() + rng.sample("this the to license use it work".split(), rng.randint(0, 2))
            notice = rng.choice(list(SHORT.values())).split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                at = rng.randrange(len(notice))
                notice[at : at + rng.randint(0, 1)] = [rng.choice(["odd", "this", "the"])] * rng.randint(0, 2)
            text += notice
        rows.append((k, " ".join(text)))
    rows += [(90, None), (91, ""), (92, "the the this"), (93, " ".join([SHORT["two"]] * 7)), (94, "x y z " + " ".join([SHORT["one"]] * 4)), (1, rows[1][1])]
    bodies = {n: words_of(t) for n, t in SHORT.items()}
    got = op.scan(h.table(spark, rows), bodies=SHORT).collect()
    want = {i: brute(bodies, words_of(t or ""), 0.8) for i, t in rows}
    assert len(got) == len(rows) and sum(len(r.found) for r in got) > 100
    for r in got:
        assert [tuple(f) for f in r.found] == want[r.doc_id], r.doc_id
        best = max(((f[2], f[1], f[0]) for f in want[r.doc_id]), default=(0, None, None))
        assert (r.license, r.coverage) == (best[2], best[1])
    assert len(next(r for r in got if r.doc_id == 93).found) == 7 and len(next(r for r in got if r.doc_id == 94).found) == 4


def test_the_place_does_not_matter():
    for name in ("Apache-2.0 (statement)", "MIT (permission)", "Zlib"):
        scanner = op.Scanner(op.templates(), 0.8)
        body = words_of(op.NOTICES[name])
        for k in range(0, 2 * len(body) + 1, max(1, len(body) // 12)):
            text = op.np.array([*range(k), *body, 5, 6], op.np.uint64)
            assert [(f[0], f[1], f[3]) for f in scanner.scan([text])[0]] == [(name, 1.0, k)]


def test_the_best_has_the_most_matched_words(spark):
    text = "Licensed under the a b c d e Apache License Version 2.0 and so on This work is licensed under the GNU General Public License, version 3."
    assert op.scan(h.table(spark, [(1, text)])).head().license == "GPL-3.0 (statement)"


def test_whole_licenses():
    bodies = op.templates()
    assert len(bodies) >= 25 and len(bodies["GPL-3.0"]) > 30_000
    scanner = op.Scanner(bodies, 0.8)
    for name in ("GPL-3.0", "LGPL-2.1", "Apache-2.0", "MPL-2.0", "BSD-3-Clause"):
        found = scanner.scan([op.np.array([1, 2, 3, *words_of(bodies[name]), 4], op.np.uint64)])[0]
        assert max(found, key=lambda f: f[2])[:2] == (name, 1.0)


def test_finds_planted_notices(spark):
    rng = random.Random(4)
    mit = op.NOTICES["MIT"]
    rows = [(1, h.prose(rng, 400) + " " + mit + " " + h.prose(rng, 400)), (2, h.prose(rng, 5000) + "\n# THIS WORK is licensed, under the GNU -- general Public License; version 3\n"), (3, h.prose(rng, 300)), (4, None), (5, ""), (6, mit.replace("without restriction", "with some limits") + mit), (7, "license the the of MIT"), (1, "again")]
    got = op.scan(h.table(spark, rows)).collect()
    by = {(r.doc_id, len(r.found)): r for r in got}
    assert by[(1, 1)].license == "MIT" and by[(1, 1)].coverage == 1.0 and by[(1, 1)].found[0].start_word == 400
    assert next(r for r in got if r.doc_id == 2).license == "GPL-3.0 (statement)"
    six = next(r for r in got if r.doc_id == 6)
    assert six.license == "MIT" and [f.license for f in six.found] == ["MIT", "MIT"] and six.coverage == 1.0
    assert all(r.license is None and r.found == [] for r in got if r.doc_id in (3, 4, 5, 7)) and len(got) == len(rows)
    assert op.scan(h.table(spark, [])).collect() == []


def test_notices_with_many_changed_single_words():
    # of the template's words nine in ten are covered, but of its distinct ones fewer than four in five are there
    body = op.NOTICES["BSD-2-Clause (conditions)"]
    words = words_of(body)
    single = [k for k, x in enumerate(words) if words.count(x) == 1]
    text = [k + 1 if k in single[::2] else x for k, x in enumerate(words)]
    assert len(set(words) & set(text)) < 0.8 * len(set(words))
    found = op.Scanner({"BSD": body}, 0.8).scan([op.np.array([3, 5, *text, 7], op.np.uint64)])[0]
    assert [(name, s, e) for name, _, _, s, e in found] == [("BSD", 3, 2 + len(words))] and found[0][2] == len(plain(words, text))
