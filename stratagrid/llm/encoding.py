"""Encoding of whole texts with a word-level memo of a tokenizer whose pre-tokens never cross white space."""

from __future__ import annotations

import os

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # an executor runs as many workers as it has cores

from tokenizers import Tokenizer  # noqa: E402

from . import text as tx

#: Words in the memo at most; beyond, it starts anew. About 40 bytes each.
MEMO_WORDS = 2_000_000
JOINED = 512


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts, as encode(text, add_special_tokens=False) gives them.

    The tokenizer must drop white space and cut words at it, as this vocabulary's does: then a text's ids are its
    words' ids in turn. Each distinct word is encoded once; the rest are looked up by a 64-bit hash, so that two of the
    words in a memo would have to share one for a wrong id (odds of one in ten million for each full memo). Words that
    hold one of the special tokens' strings are encoded alone.
    """

    def __init__(self, path: str, between: str = "<|startoftext|>"):
        self.tok = Tokenizer.from_file(path)
        self.between, self.cut = between, self.tok.token_to_id(between)
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, tx.U64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, spelled: list[bytes]) -> None:
        plain = [i for i, w in enumerate(spelled) if b"<|" not in w]
        odd = [i for i, w in enumerate(spelled) if b"<|" in w]
        ids: list = [None] * len(spelled)
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for group in groups:
            got = np.array(self.tok.encode_batch_fast([self.between.join(spelled[i].decode() for i in group)], add_special_tokens=False)[0].ids, np.uint32)
            for i, x in zip(group, np.split(got, np.flatnonzero(got == self.cut)), strict=True):
                ids[i] = x[1:] if len(x) and x[0] == self.cut else x
        for i, e in zip(odd, self.tok.encode_batch_fast([spelled[i].decode() for i in odd], add_special_tokens=False), strict=True):
            ids[i] = np.array(e.ids, np.uint32)
        count = np.array([len(x) for x in ids], np.int64)
        begin = len(self.store) + np.cumsum(count) - count
        self.store = np.concatenate([self.store, *ids])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.begin, self.count = known[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.count, count])[order]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in turn, and how many each row has."""
        starts, ends, ptr = tx.words(buf, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        unique, first, where = np.unique(tx.word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > MEMO_WORDS:
            self._clear()
        place = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != unique[inside]
        if new.any():
            raw = buf.tobytes()
            self._learn(unique[new], [raw[starts[i] : ends[i]] for i in first[new]])
            place = np.searchsorted(self.known, unique)
        where = place[where]
        count = self.count[where]
        sums = np.append(0, np.cumsum(count))
        return self.store[tx.ragged(self.begin[where], count)], np.diff(sums[ptr])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
