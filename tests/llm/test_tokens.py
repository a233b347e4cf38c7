"""The encoder, the token store and packing."""

import collections
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratagrid.llm import encoding, packing, shared
from stratagrid.llm import text as tx
from stratagrid.llm import token_store as store

from . import helpers as h

ODD = ["", "It's 2x DON'T <|endoftext|>a <|startoftext|>", "É e\u0301 ﬁ K \u2003x\u00a0y", "a\x1cb\x85c", "İI ΣΑΣ. ΣΑΣ", "😀👍🏽 test", "\u0301x y\u0301", "<|endoftext", "1234 5'6"]


@pytest.fixture(scope="module")
def direct():
    tok = Tokenizer.from_file(encoding.default_tokenizer())
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def test_encoder_equals_direct_encoding(direct):
    texts = ODD + [t for _, t in h.corpus(9)]
    enc = encoding.Encoder(encoding.default_tokenizer())
    for _ in range(2):  # the second time from the memo
        for i, j, buf, off in tx.slices(pa.array(texts, pa.string()), 2000):
            ids, counts = enc.encode(buf, off)
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [direct(t) for t in texts[i:j]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_pack_lengths(lengths):
    pieces, sizes = packing.pack_lengths(lengths, 64, 64)
    for d, n in enumerate(lengths):
        at = 0
        for _, start, length, _, _ in sorted(p for p in pieces if p[0] == d):
            assert start == at and length > 0
            at += length
        assert at == n
    for s, size in enumerate(sizes):
        at = 0
        for _, _, length, _, offset in sorted((p for p in pieces if p[3] == s), key=lambda p: p[4]):
            assert offset == at
            at += length
        assert at == size and (size == 64 or size & (size - 1) == 0)


def test_packing(spark, direct):
    rows = [(i, t) for i, t in dict(h.corpus(8)).items()] + [(900 + i, t) for i, t in enumerate(ODD)]
    got = packing.pack(h.table(spark, rows), capacity=256).collect()
    by, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(by) == {i for i, _ in rows}
    for i, t in rows:
        ids, at = np.array([*direct(t), 2], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for rs in seqs.values():
        n = sum(r.length for r in rs)
        assert all(r.sequence_tokens == n for r in rs) and (n == 256 or n & (n - 1) == 0)
    assert packing.pack(h.table(spark, [])).collect() == []


def test_a_task_has_one_tail(spark):
    """What a pool leaves goes into the next one: sequences under the capacity come at the end of a task only."""
    rng = random.Random(3)
    rows = [(i, h.prose(rng, rng.randint(1, 60))) for i in range(400)] + [(1000, h.prose(rng, 30_000))]
    whole = packing.pack(h.table(spark, rows).coalesce(1), capacity=64).collect()
    tails = {r.sequence_id: r.sequence_tokens for r in whole if r.sequence_tokens < 64}
    assert sorted(tails) == list(range(max(r.sequence_id for r in whole) - len(tails) + 1, max(r.sequence_id for r in whole) + 1)) and len(set(tails.values())) == len(tails)


def test_pools_hand_on_their_rest():
    rng = random.Random(2)
    lengths = [rng.randint(1, 300) for _ in range(500)]
    pieces, sizes, rest = packing.fill(lengths, 128, 128)
    assert set(sizes) == {128} and sum(x[2] for x in rest) == sum(lengths) % 128 and sum(x[2] for x in pieces) + sum(x[2] for x in rest) == sum(lengths)


def test_equal_ids_are_dealt_over_shards(spark, monkeypatch):
    monkeypatch.setattr(store, "LEAST", 2000)
    rng = random.Random(6)
    rows = [(None, h.prose(rng, 40)) for _ in range(60)]
    manifest = store.write(h.table(spark, rows), shared.new_folder(spark, "tokens"))
    assert len([m for m in manifest if m.documents]) > 1 and len(store.digests(spark, manifest).collect()) == 60


def test_store_round_trip(spark, direct):
    rows = h.corpus(11) + [(None, "null id"), (900, "ends <|endoftext|>")]
    manifest = store.write(h.table(spark, rows), shared.new_folder(spark, "tokens"))
    got = store.digests(spark, manifest).collect()
    assert len(got) == len(rows)
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in order:
        assert r.start == at
        at += r.n_tokens
    want = sorted((str(i), len(x := [*direct(t), 1]), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    assert store.digests(spark, store.write(h.table(spark, []), shared.new_folder(spark, "tokens"))).collect() == []


def shard(width=4):
    out = io.BytesIO()
    w = store.Writer(out, width)
    for i in range(50):
        w.add(None if i == 7 else i * 10, np.arange(i * 3))
    w.finish()
    return bytearray(out.getvalue())


class Counted:
    def __init__(self, raw):
        self.raw, self.reads = raw, []

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        self.reads.append((at, n))
        return bytes(self.raw[at : at + n])


def test_random_access_reads_one_frame():
    source = Counted(shard())
    r = store.Reader(source)
    before = len(source.reads)
    assert r.ids(20).tolist() == list(range(60)) and r.find(200) == [20] and r.find(None) == [7] and r.find(5) == []
    assert len(source.reads) == before + 1 and source.reads[-1] == (int(r.begin[20]), int(r.table["packed"][20]))
    raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(source.raw)), read_across_frames=True).read()
    assert np.frombuffer(raw, "<u4").tolist() == [x for i in range(50) for x in range(i * 3)]


def test_damage_is_seen():
    good = shard(2)
    assert store.Reader(Counted(good)).width == 2
    r = store.Reader(Counted(good))
    bad = good.copy()
    bad[int(r.begin[30]) + 12] ^= 255
    with pytest.raises((store.Corrupt, zstandard.ZstdError)):
        store.Reader(Counted(bad)).ids(30)
    with pytest.raises(store.Corrupt):
        store.Reader(Counted(good[:-1]))


def dealt(lengths, capacity, knee):
    """The rule of packing by looking at each sequence: least cost with room for all of it, else cut over the least costs."""
    cost, room, out = [0.0] * (sum(lengths) // capacity), [capacity] * (sum(lengths) // capacity), []
    for doc, start, n in [(d, 0, n) for n, d in sorted((n, d) for d, n in enumerate(lengths))][::-1]:
        while n and any(room):
            fits = [s for s in range(len(room)) if room[s] >= n] if not start else []
            s = min(fits or [s for s in range(len(room)) if room[s]], key=lambda s: (cost[s], s))
            part = min(n, room[s])
            out.append((doc, start, part, s))
            cost[s], room[s], start, n = cost[s] + part + part * part / knee, room[s] - part, start + part, n - part
    return sorted(out)


def test_packing_tries_every_sequence():
    rng = random.Random(8)
    for _ in range(40):
        lengths = rng.sample(range(1, 400), 120)  # no two alike, none over a sequence
        pieces, sizes = packing.pack_lengths(lengths, 400, 100)
        whole = sum(lengths) // 400
        assert sorted(x[:4] for x in pieces if x[3] < whole) == dealt(lengths, 400, 100)
        assert sum(x[2] for x in pieces) == sum(lengths) == sum(sizes)
