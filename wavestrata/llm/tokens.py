"""Token ids of whole texts from a public tokenizer file, encoded once per distinct word."""

from __future__ import annotations

import os
import sys
import types
from itertools import chain

import numpy as np

from wavestrata.llm.textkit import U64, hash_words, same_words, word_spans

_MOST_BYTES, _AT_ONCE = 32 << 20, 5_000
_WORD = 25  # bytes of a stored word beside its own and its ids


def _places(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, n places each."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class WordTokenizer:
    """Ids by tokenizers for a vocabulary whose pre-tokens never cross white space.

    The text's ids are then the ids of its words, one after the other. Ids are kept by the 64-bit hash of the
    word together with its bytes, which every use compares, so words with one hash still get their own ids. The store holds
    _MOST_BYTES at most; when a batch would outgrow it, words that no batch has asked for again go.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks have a core each
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.encoder.get_vocab_size() <= 1 << 16 else np.uint32
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, U64)
        self.at, self.size, self.from_, self.to = (np.zeros(0, np.int32) for _ in range(4))  # places in the ids and in the bytes
        self.pool = np.zeros(1, self.kind)  # id 0 is at place 0
        self.bytes = np.zeros(0, np.uint8)
        self.again = np.zeros(0, np.uint8)  # in how many batches a word was found, up to 255

    def _slim(self, most: int) -> None:
        """Keeps the words that were found again, the most often found ones if those are too many for `most` bytes."""
        for least in (1, 2, 4, 8, 16, 32, 64, 128, 256):
            keep = np.flatnonzero(self.again >= least)
            if _WORD * len(keep) + int(self.size[keep].sum()) * self.pool.itemsize + int((self.to - self.from_)[keep].sum()) <= most:
                break
        size, length = self.size[keep], (self.to - self.from_)[keep]
        self.pool = np.concatenate([self.pool[:1], self.pool[_places(self.at[keep], size)]])
        self.bytes = self.bytes[_places(self.from_[keep], length)]
        self.at, self.to = (1 + np.cumsum(size) - size).astype(np.int32), np.cumsum(length).astype(np.int32)
        self.keys, self.size, self.from_, self.again = self.keys[keep], size, (self.to - length).astype(np.int32), self.again[keep] >> 1

    @classmethod
    def of_worker(cls, path: str) -> WordTokenizer:
        """The one of this Python worker; it serves all tasks that the worker runs."""
        home = sys.modules.setdefault("_wavestrata_worker", types.ModuleType("_wavestrata_worker"))
        kept = home.__dict__.setdefault("tokenizers", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has."""
        encode = getattr(self.encoder, "encode_batch_fast", self.encoder.encode_batch)
        size, flat = np.empty(len(starts), np.int32), []
        for a in range(0, len(starts), _AT_ONCE):
            first, length = starts[a : a + _AT_ONCE], (ends - starts)[a : a + _AT_ONCE]
            text = np.full(int(length.sum()) + len(length) - 1, 10, np.uint8)  # words hold no line feed
            text[_places(np.cumsum(length + 1) - length - 1, length)] = data[_places(first, length)]
            ids = [x.ids for x in encode(text.tobytes().decode().split("\n"), add_special_tokens=False)]
            size[a : a + len(ids)] = [len(x) for x in ids]
            flat.append(np.fromiter(chain.from_iterable(ids), self.kind))
        return np.concatenate([np.zeros(0, self.kind), *flat]), size

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Adds new words, given in the order of their keys."""
        flat, size = self._ids(data, starts, ends)
        at = (len(self.pool) + np.cumsum(size) - size).astype(np.int32)
        to = (len(self.bytes) + np.cumsum(ends - starts)).astype(np.int32)
        from_ = (to - (ends - starts)).astype(np.int32)
        self.pool = np.concatenate([self.pool, flat])
        self.bytes = np.concatenate([self.bytes, data[_places(starts, ends - starts)]])
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.at, self.size, self.from_, self.to, self.again = (np.insert(x, where, y) for x, y in ((self.at, at), (self.size, size), (self.from_, from_), (self.to, to), (self.again, 0)))

    def _found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash among the keys, and whether it is there."""
        place = np.searchsorted(self.keys, h)
        known = np.zeros(len(h), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == h[inside]
        return place, known

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, each followed by end_id, and the n + 1 bounds of the rows."""
        starts, ends, rows = word_spans(data, offsets)
        h, first, back = np.unique(hash_words(data, starts, ends), return_index=True, return_inverse=True)
        place, known = self._found(h)
        new = np.flatnonzero(~known)
        self.again[place[known]] += self.again[place[known]] < 255
        if _WORD * (len(self.keys) + len(new)) + self.pool.nbytes + len(self.bytes) + 2 * int((ends - starts)[first[new]].sum()) > _MOST_BYTES:
            self._slim(_MOST_BYTES // 2)
            place, known = self._found(h)
            new = np.flatnonzero(~known)
        if len(new):
            self._learn(h[new], data, starts[first[new]], ends[first[new]])
            place = np.searchsorted(self.keys, h)
        own = place[back]  # the stored word of each word
        pool, text_at, text_size = self.pool, self.at[own], self.size[own]
        ours = same_words(data, starts[first], ends[first], self.bytes, self.from_[place], self.to[place])[back] & same_words(data, starts, ends, data, starts[first][back], ends[first][back])
        other = np.flatnonzero(~ours)
        if len(other):  # another word has the same hash
            flat, text_size[other] = self._ids(data, starts[other], ends[other])
            text_at[other] = len(pool) + np.cumsum(text_size[other]) - text_size[other]
            pool = np.concatenate([pool, flat])
        n = len(offsets) - 1
        at, size = np.zeros(len(starts) + n, np.int64), np.ones(len(starts) + n, np.int64)
        text = np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(rows))
        at[text], size[text] = text_at, text_size
        bounds = np.concatenate([[0], np.cumsum(size)])
        flat = pool[np.repeat(at - bounds[:-1], size) + np.arange(bounds[-1])]
        closing = rows[1:] + np.arange(n)
        if end_id:
            flat = flat.astype(np.uint32)
            flat[bounds[closing]] = end_id
        return flat, np.concatenate([[0], bounds[closing + 1]])
