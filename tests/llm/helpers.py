"""Small tables with every awkward row, and plain versions of what the operators compute."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "ba be bi bo bu da de di do du fa fe fi fo fu ga ge gi go gu ka ke ki ko ku la le li lo lu".split()


def table(spark, rows, extra=True):
    """Documents of (doc_id, text), with null columns and, if extra, columns named as operators name theirs."""
    df = spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], SCHEMA)
    if extra:
        for name in ("carry", "k1", "n_words", "bin", "row", "spans", "w", "toxic", "start", "cluster"):
            df = df.withColumn(name, F.lit(7))
    return df


def prose(rng, n, vocabulary=WORDS):
    return " ".join(rng.choice(vocabulary) + rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(n))


def corpus(seed=1):
    """Plain texts, shared passages, exact and near copies, repeats inside, and odd ones."""
    rng = random.Random(seed)
    passage, other = prose(rng, 60), prose(rng, 36)
    base = prose(rng, 200)
    rows = [(i, prose(rng, rng.randint(30, 120))) for i in range(20)]
    rows += [(100 + i, prose(rng, 20) + "\n" + passage + " " + prose(rng, rng.randint(0, 30))) for i in range(3)]
    rows += [(200, other + " x " + other), (201, prose(rng, 10) + " " + other)]
    rows += [(300 + i, base) for i in range(4)]
    for i in range(4):  # a few words differ
        words = base.split()
        for _ in range(i):
            words[rng.randrange(len(words))] = "changed" + str(i)
        rows.append((310 + i, " ".join(words)))
    rows += [(400, None), (401, ""), (402, " \t\n\x0b "), (403, "one two"), (404, "one two"), (405, "Éa é\u2003É  a\x1cb"), (406, "w " * 50), (407, "long " + prose(rng, 3000)), (408, None)]
    rows += [(0, rows[0][1]), (403, "one two"), (400, None)]  # repeated rows
    return rows


def blank_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def lower(raw):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in raw)


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def windows(words, n):
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
