"""Token ids by the ``tokenizers`` library, with repeated stretches of text encoded once per worker.

Texts are handled as the bytes of an Arrow batch. They are cut where no match of the tokenizer can reach across (before
a lone space or line feed, after a lone line feed, and between a letter or digit and a full stop or comma, all beside
characters that are told by one or two bytes), each stretch is known by a 64-bit hash and its length, and the ids of
stretches seen before come from a table of arrays.
"""

from __future__ import annotations

import functools
import os

import numpy as np

from gridloom.llm.common import mixed, places

#: Bytes of text that are encoded at once, about, and stretches and ids that a worker remembers.
PART, KEEP, POOL = 1 << 20, 1_500_000, 16_000_000
#: Bytes of a text that go through the library in one call when new stretches are joined.
JOINED = 2048

_RNG = np.random.default_rng(40409)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTH = np.uint64(0xA24BAED4963EE407)
_P = np.uint64(0x9FB21C651E98DF25)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


_PRINTED = _table((0x21, 0x7E))
_ALNUM = _table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
#: First bytes of characters that are no blanks and do not combine: printed ASCII, Latin, Greek, Cyrillic.
_BEGIN = _table((0x21, 0x7E), (0xC3, 0xCB), (0xCE, 0xD1))
#: Second bytes after 0xC3: letters, apart from the signs of multiplication and division.
_TAIL = _table((0x80, 0xBF))
_LETTER_TAIL = _TAIL & ~_table((0x97, 0x97), (0xB7, 0xB7))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, below ``n`` (a power of two)."""
    out = []
    for base in (_P, _P_INV):
        p, k = np.ones(n, np.uint64), 1
        while k < n:
            p[k : 2 * k] = p[:k] * np.uint64(pow(int(base), k, 1 << 64))
            k *= 2
        out.append(p)
    return out[0], out[1]


def cuts(b: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places where stretches of ``b`` begin; ``rows`` are the places where texts begin."""
    n = len(b)
    before = np.zeros(n, np.uint8)
    before[1:] = b[:-1]
    latin = before == 0xC3
    ends = _PRINTED[b] | (latin & _TAIL[b])  # the last byte of a character that is no blank
    alnum = _ALNUM[b] | (latin & _LETTER_TAIL[b])
    begins = _BEGIN[b]
    feed = b == 10
    blank = feed | (b == 32)
    cut = np.zeros(n, bool)
    cut[1:-1] = blank[1:-1] & ends[:-2] & begins[2:]
    cut[2:] |= feed[1:-1] & ends[:-2] & begins[2:]
    cut[1:] |= alnum[:-1] & ((b[1:] == 44) | (b[1:] == 46))
    cut[rows[rows < n]] = True
    return np.flatnonzero(cut)


class StretchEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        #: Hashes in rising order, with where the ids of each begin in ``pool`` and how many there are.
        self.keys, self.begin, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0

    def _library(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches, one after another, and the number of each.

        Stretches that begin with a space and a character and end with one may follow each other: a cut lies between.
        They go through the library together and are told apart by their tokens' places.
        """
        first = np.frombuffer(b"".join(s[:2].ljust(2) for s in stretches), np.uint8).reshape(-1, 2)
        last = np.frombuffer(b"".join(s[-2:].rjust(2) for s in stretches), np.uint8).reshape(-1, 2)
        plain = (first[:, 0] == 32) & _BEGIN[first[:, 1]] & (_PRINTED[last[:, 1]] | ((last[:, 0] == 0xC3) & _TAIL[last[:, 1]]))
        groups, size = [[]], 0
        for i in np.flatnonzero(plain).tolist():
            if size > JOINED:
                groups.append([])
                size = 0
            groups[-1].append(i)
            size += len(stretches[i])
        out: list = [None] * len(stretches)
        alone = np.flatnonzero(~plain).tolist()
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([stretches[i].decode() for i in alone], add_special_tokens=False)):
            out[i] = e.ids
        texts = [[stretches[i].decode() for i in g] for g in groups]
        for group, parts, e in zip(groups, texts, self.tokenizer.encode_batch(["".join(t) for t in texts], add_special_tokens=False)):
            end = np.cumsum([len(t) for t in parts])
            ids = np.asarray(e.ids, np.uint32)
            at = np.asarray(e.offsets, np.int64).reshape(-1, 2)[:, 0]
            edge = np.searchsorted(at, np.append(0, end))
            for k, i in enumerate(group):
                out[i] = ids[edge[k] : edge[k + 1]]
        counts = np.fromiter(map(len, out), np.int64, len(out))
        return np.concatenate([np.asarray(x, np.uint32) for x in out]) if out else np.empty(0, np.uint32), counts

    def _learn(self, keys: np.ndarray, stretches: list[bytes]) -> None:
        ids, counts = self._library(stretches)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.empty(len(self.pool), np.uint32))
        self.pool[self.used : self.used + len(ids)] = ids
        begin = self.used + np.append(0, np.cumsum(counts)[:-1])
        self.used += len(ids)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.count = np.insert(self.keys, at, keys), np.insert(self.begin, at, begin), np.insert(self.count, at, counts)

    def _stretches(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches of ``data`` that follow each other, and the number of each."""
        power, inverse = _powers(1 << max(1, (len(data) - 1).bit_length()))
        total = np.append(np.uint64(0), np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64))
        keys = mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _LENGTH)
        keys, where, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > KEEP or self.used > POOL:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            raw = data.tobytes()
            self._learn(keys[new], [raw[start[i] : end[i]] for i in where[new].tolist()])
            at = np.searchsorted(self.keys, keys)
        at = at[which]
        count = self.count[at]
        return self.pool[places(self.begin[at], count)], count

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts and an end id after each, and where each one's ids begin and the last one's end.

        ``data`` has the bytes of the texts, ``offsets`` where each begins and the last one ends.
        """
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        start = cuts(data, offsets[:-1]) if len(data) else np.empty(0, np.int64)
        end = np.append(start[1:], len(data))
        ids, counts, lo = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(end, start[lo] + 2 * PART, side="right")))
            base = start[lo]
            got = self._stretches(data[base : end[hi - 1]], start[lo:hi] - base, end[lo:hi] - base)
            ids.append(got[0])
            counts.append(got[1])
            lo = hi
        upto = np.append(0, np.cumsum(np.concatenate(counts)))
        at = upto[np.searchsorted(start, offsets)]
        return np.insert(np.concatenate(ids), at[1:], np.uint32(end_id)), at + np.arange(len(at))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> StretchEncoder:
    """One encoder for each vocabulary and Python worker."""
    return StretchEncoder(path)
