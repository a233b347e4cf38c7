"""Cost-balanced packing of token sequences.

A piece of n tokens costs n + n * n / `knee`: the linear layers and the attention inside the piece. Each task packs
pools of about POOL tokens of its own rows, so no row is shuffled. In a pool, whole sequences are cut from documents
that are longer than one; what is left, in descending length, goes to the sequence of least cost so far that has
room for all of it, else the sequence of least cost takes as much as it has room for and the rest goes on. There are as many sequences as the pool fills; what remains, less than a sequence,
goes into the task's next pool, and that of its last one to sequences whose lengths are powers of two, so nothing is
padded.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encoding, shared, text as tx

POOL = 1 << 21
PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint"


Piece = tuple[int, int, int, int, int]


def fill(lengths: list[int], capacity: int = 4096, knee: int = 4096) -> tuple[list[Piece], list[int], list[list[int]]]:
    """Pieces (document, start, length, sequence, offset), the sequences' lengths, all of them full, and the rest
    (document, start, length), less than a sequence."""
    pieces: list[Piece] = []
    sizes: list[int] = []
    left: list[tuple[int, int, int]] = []  # (-length, document, start)
    for doc, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            pieces.append((doc, k * capacity, capacity, len(sizes), 0))
            sizes.append(capacity)
        if n % capacity:
            left.append((-(n % capacity), doc, whole * capacity))
    left.sort()
    total = -sum(x[0] for x in left)
    every = [(0.0, len(sizes) + i) for i in range(total // capacity)]
    cost, room = {s: 0.0 for _, s in every}, {s: capacity for _, s in every}
    sizes += [capacity] * len(every)
    # able: sequences that had room for the last length asked for; short: by room. Lengths descend, so able ones stay so
    # until they take a piece; entries whose cost or room has changed since are stale.
    able: list[tuple[float, int]] = []
    short = [(-capacity, s) for _, s in every]
    rest: list[list[int]] = []

    def put(seq: int, doc: int, start: int, n: int) -> None:
        pieces.append((doc, start, n, seq, capacity - room[seq]))
        room[seq] -= n
        cost[seq] += n + n * n / knee
        if room[seq]:
            heapq.heappush(every, (cost[seq], seq))
            heapq.heappush(short, (-room[seq], seq))

    def least(heap: list[tuple[float, int]]) -> int | None:
        while heap:
            c, seq = heapq.heappop(heap)
            if c == cost[seq] and room[seq]:
                return seq
        return None

    for minus, doc, start in left:
        n = -minus
        while short and -short[0][0] >= n:
            r, seq = heapq.heappop(short)
            if -r == room[seq]:
                heapq.heappush(able, (cost[seq], seq))
        fits = least(able)
        if fits is not None:
            put(fits, doc, start, n)
            continue
        while n and (seq := least(every)) is not None:
            part = min(n, room[seq])
            put(seq, doc, start, part)
            start, n = start + part, n - part
        if n:
            rest.append([doc, start, n])
    return pieces, sizes, rest


def pack_lengths(lengths: list[int], capacity: int = 4096, knee: int = 4096) -> tuple[list[Piece], list[int]]:
    """Pieces and the sequences' lengths, with the rest in sequences of lengths that are powers of two."""
    pieces, sizes, rest = fill(lengths, capacity, knee)
    tail = sum(x[2] for x in rest)
    for bit in reversed(range(tail.bit_length())):
        if tail >> bit & 1:
            space, at = 1 << bit, 0
            while space:
                doc, start, n = rest[0]
                part = min(n, space)
                pieces.append((doc, start, part, len(sizes), at))
                at, space = at + part, space - part
                rest[0] = [doc, start + part, n - part]
                if part == n:
                    rest.pop(0)
            sizes.append(1 << bit)
    return pieces, sizes


def _pack(tokenizer: str, end_id: int, capacity: int, knee: int):
    names = ["carry", *(x.split()[0] for x in PIECE.split(", "))]

    class Pools:
        """Rows' tokens, or what a pool left of them: carry, tokens, place of the first of them, tokens of the document."""

        def __init__(self):
            self.first = TaskContext.get().partitionId() << 40
            self.clear()

        def clear(self) -> None:
            self.carry: list[pa.Array] = []
            self.tokens: list[np.ndarray] = []
            self.base: list[int] = []
            self.total: list[int] = []
            self.size = 0

        def add(self, carry: pa.Array, tokens: list[np.ndarray], base: list[int], total: list[int]) -> None:
            self.carry.append(carry)
            self.tokens += tokens
            self.base += base
            self.total += total
            self.size += sum(len(x) for x in tokens)

        def close(self, last: bool) -> Iterator[pa.RecordBatch]:
            lengths = [len(x) for x in self.tokens]
            pieces, sizes, *rest = pack_lengths(lengths, capacity, knee) if last else fill(lengths, capacity, knee)
            carry = pa.concat_arrays(self.carry)
            if pieces:
                doc, start, length, seq, at = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
                crc = [zlib.crc32(self.tokens[d][s : s + n]) for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                base, total = np.array(self.base, np.int64)[doc], np.array(self.total, np.int64)[doc]
                cols = [carry.take(pa.array(doc)), *map(pa.array, (start + base, length, np.array(crc, np.int64), total, seq + self.first, at, np.array(sizes, np.int64)[seq]))]
                yield pa.RecordBatch.from_arrays(cols, names)
            self.first += len(sizes)
            tokens, base, total = self.tokens, self.base, self.total
            self.clear()
            for d, s, n in rest[0] if rest else []:
                self.add(carry.slice(d, 1), [tokens[d][s : s + n].copy()], [base[d] + s], [total[d]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pools = encoding.encoder(tokenizer), Pools()
        for b in batches:
            for i, j, buf, off in tx.slices(b.column("text")):
                got, counts = enc.encode(buf, off)
                at = np.append(0, np.cumsum(counts))
                tokens = [np.append(got[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4") for k in range(j - i)]
                pools.add(b.column("carry").slice(i, j - i), tokens, [0] * (j - i), [len(x) for x in tokens])
                if pools.size >= POOL:
                    yield from pools.close(False)
        if pools.tokens:
            yield from pools.close(True)

    return tx.trimmed(run)


def pack(docs: DataFrame, text: str = "text", carry: list[str] | None = None, tokenizer: str | None = None, end_id: int = 2, capacity: int = 4096, knee: int = 4096) -> DataFrame:
    """A row for each piece: the columns in `carry` (default doc_id), start, length, ids_crc32, doc_tokens, sequence_id,
    offset, sequence_tokens.

    A document's ids are its text's, then end_id; a null or empty text has end_id alone. Each id is in one piece. The
    sequences hold `capacity` ids, but for those of a task's last ones whose length is a power of two. sequence_id is
    unique in the result and ascends in a task. Repeated rows are packed as often as they come.
    """
    shared.prepare(docs.sparkSession)
    rows = docs.select(F.struct(*(carry or ["doc_id"])).alias("carry"), F.col(text).alias("text"))
    kind = rows.schema["carry"].dataType.simpleString()
    return rows.mapInArrow(_pack(tokenizer or encoding.default_tokenizer(), end_id, capacity, knee), f"carry {kind}, {PIECE}").select("carry.*", *(x.split()[0] for x in PIECE.split(", ")))
