"""Substring deduplication with prefix-partitioned suffix trees.

A suffix starts at every word that has `window` - 1 words after it in its document. Two suffixes that agree in
their first `window` words repeat a passage; in the suffix tree of the corpus they meet in an internal node of
depth `window` or more. The tree is never held whole:

1. *Routing.* A suffix is routed by the least of the hashed `SEED`-word strings inside its first `window` words.
   Equal windows have the same least seed, and neighbouring suffixes mostly share it, so a run of them travels as one
   segment of text (about three words for each suffix, not `window`). A seed that more than `group` suffixes share is
   too large for a task: its suffixes are routed by the longest prefix there is, all `window` words, as 128 bits, and
   such a prefix is itself a node of the wanted depth, so that a count with map-side sums decides it.
2. *Groups.* In a task, suffixes are split by prefixes of `STEP` words, and by longer prefixes where a group is still
   over `SUBTREE` suffixes, so that one subtree at a time is in memory.
3. *Subtrees.* Each subtree is grown top-down: children are the runs of equal next `STEP` words, leaves (runs of one)
   go at once. Nodes that reach the depth of `window` are the deep internal nodes; what they cover is compared byte by
   byte, and yields the repeated intervals. Nodes are not grown deeper: a maximal repeat of a document is the union of
   its overlapping intervals.

Equal documents share a key, so at most two copies of a text leave a task's batch of rows. Words over 64 bytes travel as
128-bit digests, so the bytes of a task follow from `group`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, text as tx

SEED = 3
STEP = 5
SUBTREE = 1 << 20
FLUSH_BYTES = 24 << 20
#: Bytes of text routed at once; their segments are about three times as long, and are gathered by 64-bit places.
SLICE = 1 << 20
#: Entries of a task's tables of seeds and of texts seen, at most.
TABLE = 1 << 21
SEEN = 100_000
SEGMENTS = "bin int, payload binary"
SUFFIXES = "f1 bigint, f2 bigint, k1 bigint, k2 bigint, pos int"
INTERVAL = "k1 bigint, k2 bigint, start_word int, end_word int"


def _runs(mins: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of the runs of successive suffixes of equal (document, least seed)."""
    new = np.ones(len(mins), bool)
    new[1:] = (mins[1:] != mins[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(mins)))


def _suffixes(buf: np.ndarray, off: np.ndarray, window: int):
    """Of some rows: first and end byte of each word; each row's first word; word index, row and least seed of each suffix."""
    starts, ends, ptr = tx.words(buf, off)
    seeds = tx.grams(tx.word_hashes(buf, starts, ends), SEED)
    counts = np.maximum(np.diff(ptr) - window + 1, 0)
    at = tx.ragged(ptr[:-1], counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    least = tx.sliding_min(seeds, window - SEED + 1)
    return starts, ends, ptr, at, doc, least[at] if len(at) else seeds[:0]


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)


def _count_seeds(window: int, dropped: int):
    """(seed, suffixes) of a task's seeds with more than `dropped` suffixes, and (null, all its suffixes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [(np.zeros(0, tx.U64), np.zeros(0, np.int64))], 0, 0
        out = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["seed", "n"])
        for b in batches:
            for _, _, buf, off in tx.slices(b.column("text")):
                *_, at, doc, least = _suffixes(*tx.canonical(buf, off), window)
                first, n = _runs(least, doc, at)
                total += len(least)
                held.append(_summed([(least[first], n)]))
                size += len(held[-1][0])
                if size > TABLE:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size > TABLE // 2:
                        yield out(*held[0])
                        held, size = [(np.zeros(0, tx.U64), np.zeros(0, np.int64))], 0
        keys, n = _summed(held)
        yield out(keys[n > dropped], n[n > dropped])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([total], pa.int64())], ["seed", "n"])

    return tx.trimmed(run)


def _packed(k1, k2, pos, size, lengths, body: bytes) -> bytes:
    head = np.array([len(k1)], np.int64)
    return b"".join([*(x.tobytes() for x in (head, k1, k2, pos.astype(np.uint32), size.astype(np.uint32), lengths.astype(np.uint32))), body])


def _unpacked(raw: bytes) -> list[np.ndarray]:
    n, place, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in (np.int64, np.int64, np.uint32, np.uint32, np.uint32):
        out.append(np.frombuffer(raw, kind, n, place))
        place += n * np.dtype(kind).itemsize
    return [*out, np.frombuffer(raw, np.uint8, -1, place)]


class _Seen:
    """Of equal texts two leave a task's batch of rows at most."""

    def __init__(self):
        self.times: dict[tuple[int, int], int] = {}

    def fresh(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        out = np.ones(len(k1), bool)
        for i, key in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):
            n = self.times[key] = self.times.get(key, 0) + 1
            out[i] = n <= 2
        if len(self.times) > SEEN:
            self.times = {}
        return out


def _route(window: int, heavy: np.ndarray, bins: int):
    """Segments of light seeds, packed by bin."""

    def pack(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        bin_, k1, k2, pos, size, lengths = (np.concatenate([x[i] for x in held]) for i in range(6))
        body = np.concatenate([x.pop() for x in held])
        order = np.argsort(bin_, kind="stable")
        begin = np.cumsum(lengths) - lengths
        edges = np.flatnonzero(np.append(True, np.diff(bin_[order]) != 0))
        ids, payloads = [], []
        packer = zstandard.ZstdCompressor(level=1)
        for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
            pick = order[a:b]
            raw = b"".join(body[s : s + n].tobytes() for s, n in zip(begin[pick].tolist(), lengths[pick].tolist(), strict=True))
            payloads.append(packer.compress(_packed(k1[pick], k2[pick], pos[pick], size[pick], lengths[pick], raw)))
            ids.append(int(bin_[pick[0]]))
        for i in range(0, len(ids), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 5000], pa.int32()), pa.array(payloads[i : i + 5000], pa.binary())], ["bin", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, _Seen()
        for b in batches:
            k1, k2 = (b.column(k).to_numpy() for k in shared.KEY)
            fresh = seen.fresh(k1, k2)
            for i, j, buf, off in tx.slices(b.column("text"), SLICE):
                buf, off = tx.canonical(buf, off)
                starts, ends, ptr, at, doc, least = _suffixes(buf, off, window)
                keep = fresh[i:j][doc]
                if len(heavy):
                    keep &= ~np.isin(least, heavy)
                at, doc, least = at[keep], doc[keep], least[keep]
                if not len(at):
                    continue
                first, size = _runs(least, doc, at)
                lo, hi = starts[at[first]], ends[at[first] + size + window - 2]
                place = (tx.mix(least[first] ^ tx.U64(0x77)) % tx.U64(bins)).astype(np.int64)
                held.append([place, k1[i:j][doc[first]], k2[i:j][doc[first]], at[first] - ptr[doc[first]], size, hi - lo, buf[tx.ragged(lo, hi - lo)]])
                n += len(held[-1][6])
                if n >= FLUSH_BYTES:
                    yield from pack(held)
                    held, n, seen = [], 0, _Seen()
        yield from pack(held)

    return tx.trimmed(run)


def _deep(window: int, heavy: np.ndarray):
    """A row for each suffix of a heavy seed: 128 bits of its first `window` words, from two independent word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for b in batches:
            k1, k2 = (b.column(k).to_numpy() for k in shared.KEY)
            fresh = seen.fresh(k1, k2)
            for i, j, buf, off in tx.slices(b.column("text")):
                buf, off = tx.canonical(buf, off)
                starts, ends, ptr, at, doc, least = _suffixes(buf, off, window)
                pick = np.isin(least, heavy) & fresh[i:j][doc]
                if not pick.any():
                    continue
                at, doc = at[pick], doc[pick]
                f1, f2 = (tx.grams(tx.word_hashes(buf, starts, ends, f), window, 31 + f)[at].view(np.int64) for f in (0, 1))
                for s in range(0, len(at), 100_000):
                    e = slice(s, s + 100_000)
                    cols = (f1[e], f2[e], k1[i:j][doc[e]], k2[i:j][doc[e]], (at[e] - ptr[doc[e]]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["f1", "f2", "k1", "k2", "pos"])

    return tx.trimmed(run)


def deep_nodes(words: np.ndarray, at: np.ndarray, window: int, subtree: int = SUBTREE) -> np.ndarray:
    """Which of the suffixes that begin at words[at] share their first `window` words with another one.

    Prefixes of STEP words, then of 2 * STEP and so on, split the suffixes until a group has at most `subtree` of them;
    then its subtree is grown, level by level, without its leaves.
    """
    step = min(STEP, window)
    label = tx.grams(words.astype(tx.U64), step, 41)
    depths = [*range(0, window - step + 1, step)]
    if depths[-1] + step < window:
        depths.append(window - step)
    found = np.zeros(len(at), bool)
    groups = [(np.arange(len(at)), 0)]
    while groups:
        who, level = groups.pop()
        if len(who) <= subtree or level >= len(depths):
            found[_grow(label, words, at, who, depths, level, window)] = True
            continue
        key = label[at[who] + depths[level]]
        order = np.argsort(key)
        who, key = who[order], key[order]
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(cut, len(key)))
        for i in np.flatnonzero(sizes > subtree):  # too many share this prefix: a longer one
            groups.append((who[cut[i] : cut[i] + sizes[i]], level + 1))
        inner = (sizes > 1) & (sizes <= subtree)
        cut, sizes = cut[inner], sizes[inner]
        part = (np.cumsum(sizes) - sizes) // subtree  # small siblings share a subtree
        for p in np.unique(part):
            found[_grow(label, words, at, who[tx.ragged(cut[part == p], sizes[part == p])], depths, level, window)] = True
    return found


def _grow(label, words, at, who, depths, level, window):
    node = np.zeros(len(who), tx.U64)
    for d in depths[level:]:
        if not len(who):
            return who
        key = tx.mix(node * tx.U64(0x9E3779B97F4A7C15) + label[at[who] + d])
        order = np.argsort(key)
        who, key = who[order], key[order]
        same = key[1:] == key[:-1]
        inner = np.append(same, False) | np.append(False, same)
        who, node = who[inner], key[inner]
    if not len(who):
        return who
    head = np.append(True, node[1:] != node[:-1])
    leader = who[np.flatnonzero(head)[np.cumsum(head) - 1]]
    equal = np.ones(len(who), bool)
    for d in range(window):
        equal &= words[at[who] + d] == words[at[leader] + d]
    # A suffix that differs from its node's first one (a collision of labels) is settled on its own words.
    odd = who[~equal]
    good = equal & (np.bincount(np.cumsum(head) - 1, equal)[np.cumsum(head) - 1] > 1)
    if len(odd):
        key: dict[bytes, list] = {}
        for x in odd:
            key.setdefault(words[at[x] : at[x] + window].tobytes(), []).append(x)
        more = [x for xs in key.values() if len(xs) > 1 for x in xs]
        return np.concatenate([who[good], np.array(more, dtype=who.dtype)])
    return who[good]


def same_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, labels: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The labels, among words `which`, that words of different bytes share."""
    _, first, where = np.unique(labels[which], return_index=True, return_inverse=True)
    lead, n = which[first][where], ends[which] - starts[which]
    differ = n != ends[lead] - starts[lead]
    others = np.flatnonzero((lead != which) & ~differ)
    for i in range(0, len(others), 1 << 17):
        pick = others[i : i + (1 << 17)]
        size = n[pick]
        unlike = buf[tx.ragged(starts[which[pick]], size)] != buf[tx.ragged(starts[lead[pick]], size)]
        differ[pick] = np.logical_or.reduceat(unlike, np.cumsum(size) - size)
    return np.unique(labels[which[differ]])


def repeats(buf: np.ndarray, off: np.ndarray, window: int, subtree: int = SUBTREE) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place in it) of each suffix of the segments that shares its first `window` words with another one.

    Nodes are grown over 64-bit labels of words. Then the words that the nodes cover are compared byte by byte with the
    first word of their label; where a label stands for several words, those get labels of their own, and the nodes are
    grown anew.
    """
    starts, ends, ptr = tx.words(buf, off)
    labels = tx.word_hashes(buf, starts, ends)
    size = np.diff(ptr) - window + 1
    at, seg = tx.ragged(ptr[:-1], size), np.repeat(np.arange(len(size)), size)
    while True:
        hit = np.flatnonzero(deep_nodes(labels, at, window, subtree))
        cover = np.zeros(len(labels) + 1, np.int64)
        np.add.at(cover, at[hit], 1)
        np.add.at(cover, at[hit] + window, -1)
        odd = same_words(buf, starts, ends, labels, np.flatnonzero(np.cumsum(cover[:-1]) > 0))
        if not len(odd):
            return seg[hit], at[hit] - ptr[seg[hit]]
        for i in np.flatnonzero(np.isin(labels, odd)).tolist():
            labels[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")


def _subtrees(window: int, subtree: int):
    def run(t: pa.Table) -> pa.Table:
        unpacker = zstandard.ZstdDecompressor()
        parts = [_unpacked(unpacker.decompress(value.as_buffer())) for chunk in t.column("payload").chunks for value in chunk]
        k1, k2, pos, _, lengths, buf = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        seg, place = repeats(buf, np.append(0, np.cumsum(lengths.astype(np.int64))), window, subtree)
        place = place + pos.astype(np.int64)[seg]
        # successive hits of a segment make one interval
        new = np.ones(len(seg), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(seg))[: len(first)] - 1
        return pa.table({"k1": k1[seg[first]], "k2": k2[seg[first]], "start_word": place[first].astype(np.int32), "end_word": (place[last] + window).astype(np.int32)})

    def tidy(t: pa.Table) -> pa.Table:
        out = run(t)
        tx.trim()
        return out

    return tidy


def repeated_intervals(docs: DataFrame, text: str = "text", window: int = 35, group: int = 500_000, subtree: int = SUBTREE) -> DataFrame:
    """Intervals of words, [start_word, end_word), that windows occurring twice or more cover, by key of text.

    Rows (k1, k2, start_word, end_word), some of them repeated; intervals of one text can overlap. Null and short texts
    have none. group: suffixes that a task gets at most under one seed; subtree: suffixes in memory as one subtree.
    """
    if window < SEED:
        raise ValueError(f"a window has {SEED} words at least")
    spark = docs.sparkSession
    shared.prepare(spark)
    rows = docs.select(F.col(text).alias("text"), *shared.text_key(F.col(text))).where(F.octet_length("text") >= 2 * window - 1)
    # what all tasks drop of a seed is half a group at most, so each seed over `group` is among those counted over half of it
    dropped = group // (2 * max(1, rows.rdd.getNumPartitions()))
    counts = rows.select("text").mapInArrow(_count_seeds(window, dropped), "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
    found = counts.where((F.col("n") > group // 2) | F.col("seed").isNull()).collect()  # 2 * total / group + 1 rows at most
    total = sum(r.n for r in found if r.seed is None)
    heavy = np.sort(np.array([r.seed for r in found if r.seed is not None], np.int64).view(tx.U64))
    light = rows.mapInArrow(_route(window, heavy, shared.parts(total, group)), SEGMENTS)
    found = light.groupBy("bin").applyInArrow(_subtrees(window, subtree), INTERVAL)
    if len(heavy):
        deep = rows.mapInArrow(_deep(window, heavy), SUFFIXES)
        nodes = shared.materialise(deep.groupBy("f1", "f2").agg(F.count("*").alias("n")).where("n > 1"), "nodes")
        hits = shared.join_spread(deep, nodes.select("f1", "f2"), ["f1", "f2"], shared.hot_keys(nodes, ["f1", "f2"]), "left_semi")
        found = found.unionByName(hits.select("k1", "k2", F.col("pos").alias("start_word"), (F.col("pos") + window).alias("end_word")))
    return found


def _cut(want_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = pa.Table.from_batches([b])
            out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
            for value, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
                words = (value.as_py() or "").encode().split()
                n = len(words)
                if spans:
                    kept, end = [], 0
                    for s in sorted(spans, key=lambda x: (x["start_word"], x["end_word"])):
                        if s["start_word"] > end:
                            kept += words[end : s["start_word"]]
                        end = max(end, s["end_word"])
                    words = kept + words[end:]
                joined = b" ".join(words)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                out["kept_text"].append((value.as_py() if n == len(words) else joined.decode()) if want_text else None)
            got = {k: pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in out.items()}
            for x in b.drop_columns(["text", "spans"]).append_column("n_words", got["n_words"]).append_column("n_removed", got["n_removed"]).append_column("kept_sha256", got["kept_sha256"]).append_column("kept_text", got["kept_text"]).to_batches():
                yield x

    return tx.trimmed(run)


def substring_dedup(docs: DataFrame, text: str = "text", window: int = 35, carry: list[str] | None = None, want_text: bool = False, **limits: int) -> DataFrame:
    """One row for each row of docs: the columns in `carry` (default doc_id), n_words, n_removed, kept_sha256, kept_text.

    Words are runs of bytes other than space and 09-0D. A word goes if a window of `window` words covers it whose word
    sequence also starts anywhere else in the table, in the same document or not. kept_text (null unless want_text) is
    the text itself if nothing goes, else the kept words joined by a space. Null and empty texts have no words; repeated
    rows and equal texts repeat one another; columns not in carry are not read.
    """
    carry = ["doc_id"] if carry is None else carry
    found = repeated_intervals(docs, text, window, **limits).groupBy("k1", "k2").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    rows = docs.select(F.struct(*carry).alias("carry"), F.col(text).alias("text"), *shared.text_key(F.col(text)))
    joined = shared.join_spread(rows, found, shared.KEY, shared.hot_texts(rows.select(*shared.KEY))).select("carry", "text", "spans")
    kind = joined.schema["carry"].dataType.simpleString()
    return joined.mapInArrow(_cut(want_text), f"carry {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string").select("carry.*", "n_words", "n_removed", "kept_sha256", "kept_text")
