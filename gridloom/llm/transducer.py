"""Byte-level BPE by a lazily determinised transducer, with a streaming decoder.

A run of tokens is what the merges make of its bytes exactly if every two neighbours are what the merges make of theirs. So
each prefix of a piece has one encoding, and its last token is the one that ends there and goes with the last token of what is
before it. The transducer reads a piece byte by byte and keeps every token that may be open: its node in the trie of the
vocabulary, and what the token before it does to the next one. Sets of open tokens are its states, and a step puts out the last token of the prefix. A
step from a state by a byte is worked out when it is first met and kept; if too many are kept, all are forgotten and learned
anew. Open tokens begin at most a longest token back, so what they have before them in common is emitted after a bounded
lookahead: at the end of a piece or of a window of a long one.

The decoder gives out whole characters only: a state machine over the last bytes of each chunk tells where an unfinished
character begins, and the bytes from there on wait for the next chunk.
"""

from __future__ import annotations

import base64
import bisect
import functools
import gc
import sys
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

#: Steps, pairs, pieces and stretches that a worker remembers.
STEPS, PAIRS, PIECES, STRETCHES = 280_000, 100_000, 50_000, 240_000
#: Bytes of a long piece after which its sure tokens are emitted; a rank that no pair has.
WINDOW, NEVER = 1 << 12, 1 << 62
#: Bytes of a piece that are worth remembering as a whole.
SHORT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Made(NamedTuple):
    """How a token is made: whether the merges of its bytes reach it, in the order of ranks; the tokens at its left and at
    its right edge meanwhile, each with the rank that ends it."""

    reached: bool
    ordered: bool
    left: list[tuple[bytes, int]]
    right: list[tuple[bytes, int]]


class _Unordered(Exception):
    """A token ranks before one that it is made of."""


class MergeTransducer:
    """Ids of pieces by rank: of all neighbours whose joint bytes are a token, the one of least rank (the first of those) merges first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{len(missing)} single bytes have no token, so that not every text can be encoded")
        #: Children of trie nodes by ``node << 8 | byte``; bytes down to a node; the token whose bytes lead to it.
        self.child: dict[int, int] = {}
        self.depth = [0]
        self.at: dict[int, int] = {}
        #: Ranks of the tokens that a token is the left part of.
        self.onward: dict[bytes, list[int]] = {}
        for token, rank in ranks.items():
            node = 0
            for i, b in enumerate(token, 1):
                key = node << 8 | b
                down = self.child.get(key, 0)
                if not down:
                    down = self.child[key] = len(self.depth)
                    self.depth.append(i)
                node = down
                if i < len(token) and token[i:] in ranks and token[:i] in ranks:
                    self.onward.setdefault(token[:i], []).append(rank)
            self.at[node] = rank
        for found in self.onward.values():
            found.sort()
        # The rest is worked out for the tokens that are met.
        self.ends: dict[int, int] = {}
        self.made: dict[int, Made] = {}
        self._begin(ordered=True)

    def _begin(self, ordered: bool) -> None:
        #: Whether merges come in the order of ranks, as far as is known. If not, joint bytes are merged to tell neighbours.
        self.ordered = ordered
        self.kind: dict[int, int] = {}
        self.kinds: dict[tuple, int] = {}
        self.edges: list[tuple] = [()]
        self.pairs: dict[int, bool] = {}
        self._forget()

    def making(self, rank: int) -> Made:
        """How the merges make a token."""
        made = self.made.get(rank)
        if made is None:
            token = self.tokens[rank]
            if len(token) == 1:
                made = Made(True, True, [(token, NEVER)], [(token, NEVER)])
            else:
                parts = self.merged(token, short=1)
                if len(parts) != 2:
                    made = Made(False, False, [], [])
                else:
                    a, b = (self.ranks[x] for x in parts)
                    x, y = self.making(a), self.making(b)
                    made = Made(True, x.ordered and y.ordered and rank > max(a, b), [(token, NEVER), (parts[0], rank), *x.left[1:]], [(token, NEVER), (parts[1], rank), *y.right[1:]])
            self.made[rank] = made
        if self.ordered and made.reached and not made.ordered:
            raise _Unordered
        return made

    def _ending(self, node: int) -> int:
        """The token that ends at a node, or -1. A token that its own bytes do not merge to ends nowhere; only a piece that equals it gets it."""
        token = self.at.get(node, -1)
        if token >= 0 and not self.making(token).reached:
            token = -1
        self.ends[node] = token
        return token

    def _kind(self, rank: int) -> int:
        """What a token does to the one after it: the tokens at its right edge that could merge on, and up to which rank.

        Tokens that do the same are of one class (0: nothing is before), so that states tell classes and not tokens.
        """
        made = self.making(rank)
        does = tuple((a, ranks[n - 1]) for a, gone in made.right if (ranks := self.onward.get(a)) and (n := bisect.bisect_left(ranks, gone)))
        if not self.ordered:
            does = (self.tokens[rank],)
        kind = self.kind[rank] = self.kinds.setdefault(does, len(self.edges))
        if kind == len(self.edges):
            self.edges.append(does)
        return kind

    def merged(self, raw: bytes, short: int = 0) -> list[bytes]:
        """The tokens of a few bytes by the merges themselves; ``short=1`` stops before the merge that would leave one token."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        get = self.ranks.get
        while len(parts) > 1 + short:
            best, at = min((get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if best == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _apart(self, kind: int, right: int) -> bool:
        edge = self.edges[kind]
        if not self.ordered:
            return self.merged(edge[0] + self.tokens[right]) == [edge[0], self.tokens[right]]
        get = self.ranks.get
        for a, most in edge:
            for b, taken in self.making(right).left:
                if get(a + b, NEVER) <= min(most, taken):  # a rank equal to that of what takes b: the first place merges first
                    return False
        return True

    def neighbours(self, kind: int, right: int) -> bool:
        """Whether the merges of the joint bytes of a token of this class and ``right`` end with these two: none crosses the border.

        One that could joins a token at the right edge of the first and one at the left edge of the second, both of which
        are still there when its rank has its turn.
        """
        key = kind << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(kind, right)
        return known

    def _forget(self) -> None:
        #: A state: the open tokens, oldest first, each as its node and the class of the token before it.
        self.states = [(0,)]
        self.number = {self.states[0]: 0}
        #: The next state, and the last token of what has been read.
        self.steps: dict[int, tuple[int, int]] = {}

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        moved, last = [], -1
        child, ends = self.child, self.ends
        for item in self.states[state]:
            node = child.get(item >> 20 << 8 | byte, 0)
            if node:
                kind = item & 0xFFFFF
                moved.append(node << 20 | kind)
                if last < 0:
                    token = ends.get(node)
                    if token is None:
                        token = self._ending(node)
                    if token >= 0 and (not kind or self.neighbours(kind, token)):
                        last = token
        if last < 0:
            raise ValueError("the ranks are not those of merges: a prefix of a piece has no encoding")
        moved.append(self.kind.get(last) or self._kind(last))
        new = tuple(moved)
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
        found = self.steps[state << 8 | byte] = (number, last)
        return found

    def _back(self, lasts: list[int], end: int) -> list[int]:
        """The tokens of the first ``end`` bytes, from the last token of each prefix."""
        out, size = [], self.size
        while end > 0:
            token = lasts[end - 1]
            out.append(token)
            end -= size[token]
        out.reverse()
        return out

    def _read(self, raw: bytes, state: int, lasts: list[int]) -> int:
        """Go on from a state; ``lasts`` gets the last token of each further prefix."""
        get, add = self.steps.get, lasts.append
        for b in raw:
            step = get(state << 8 | b)
            if step is None:
                step = self._step(state, b)
            state, last = step
            add(last)
        return state

    def piece(self, raw: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        if len(self.steps) > STEPS:
            self._forget()
        try:
            if len(raw) > WINDOW:
                return self._piece(raw)
            # As in _read and _back, of which this is the short way.
            state, lasts, get, size, out = 0, [], self.steps.get, self.size, []
            for b in raw:
                step = get(state << 8 | b)
                if step is None:
                    step = self._step(state, b)
                state, last = step
                lasts.append(last)
            end = len(lasts)
            while end > 0:
                last = lasts[end - 1]
                out.append(last)
                end -= size[last]
            out.reverse()
            return out
        except _Unordered:  # met the first token of this kind: all is learned anew
            self._begin(ordered=False)
            return self._piece(raw)

    def _piece(self, raw: bytes) -> list[int]:
        lasts: list[int] = []
        if len(raw) <= WINDOW:
            self._read(raw, 0, lasts)
            return self._back(lasts, len(lasts))
        out: list[int] = []
        state = 0
        for lo in range(0, len(raw), WINDOW):
            if len(self.steps) > STEPS:  # the open tokens go on in a fresh machine
                now = self.states[state]
                self._forget()
                state = self.number.setdefault(now, 1)
                self.states += [now] * state
            state = self._read(raw[lo : lo + WINDOW], state, lasts)
            # What all open tokens have before them is sure: each one's predecessors lead back to one place.
            places = {len(lasts) - self.depth[item >> 20] for item in self.states[state]}
            while len(places) > 1:
                at = max(places)
                places.remove(at)
                places.add(at - self.size[lasts[at - 1]])
            sure = places.pop()
            out += self._back(lasts, sure)
            lasts = lasts[sure:]
        return out + self._back(lasts, len(lasts))


class _Kept(dict):
    """Ids by text, worked out when first asked for. When it is full, what was asked for since the last time stays at hand and the rest goes."""

    def __init__(self, make, most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.make(text)
            if len(text) > SHORT:
                return ids
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[text] = ids
        return ids


class _Blank(Exception):
    """A space does not stand alone between two characters that are no blanks."""


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``lone_space_begins``: in the pattern, a single space between two characters that are no blanks always begins a piece, and
    a space with nothing but letters up to the next one is one piece. Then texts are cut there first, and the pattern sees each
    other stretch once.
    """

    def __init__(self, path: str, pattern: str, lone_space_begins: bool = False):
        import regex

        self.machine = MergeTransducer(read_ranks(path))
        self.split = regex.compile(pattern).findall
        self.cut = lone_space_begins
        self.pieces = _Kept(self._piece, PIECES)
        self.stretches = _Kept(self._stretch, STRETCHES)

    def _piece(self, piece: str) -> bytes:
        ids = array("I", self.machine.piece(piece.encode()))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def _stretch(self, word: str) -> bytes:
        if word.isalpha():
            return self._piece(f" {word}")
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Blank
        pieces = self.split(f" {word}")
        # Most stretches are one piece; it is known as the stretch.
        return self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self.pieces.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        if not self.cut:
            return self._whole(text)
        first, *rest = text.split(" ")
        if not rest:
            return self._whole(text)
        try:
            if not first or first[-1].isspace():
                raise _Blank
            return self._whole(first) + b"".join(map(self.stretches.__getitem__, rest))
        except _Blank:
            return self._whole(text)


class Decoder:
    """Decodes such ids, whole or as a stream."""

    def __init__(self, path: str):
        self.tokens = {rank: token for token, rank in read_ranks(path).items()}

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; an id that no token has is an error."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def stream(self, chunks: Iterable[bytes]) -> Iterator[str]:
        """Text as soon as its characters are whole, for chunks of ids."""
        held = Utf8Stream()
        for ids in chunks:
            if text := held.feed(self.decode(ids)):
                yield text
        if text := held.close():
            yield text


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str, lone_space_begins: bool) -> Encoder:
    """One encoder for each vocabulary and Python worker; its tables are never garbage, so they are not searched for any."""
    made = Encoder(path, pattern, lone_space_begins)
    gc.freeze()
    return made


@functools.lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _utf8_machine() -> list[dict[int, int]]:
    """Moves between states by a byte. State 0: between characters; others: what may follow within one. No move: no UTF-8."""
    tail = range(0x80, 0xC0)
    to = lambda bytes_, state: dict.fromkeys(bytes_, state)
    start = to(range(0x80), 0) | to(range(0xC2, 0xE0), 1) | {0xE0: 3, 0xED: 4, 0xF0: 6, 0xF4: 7} | to([*range(0xE1, 0xED), 0xEE, 0xEF], 2) | to(range(0xF1, 0xF4), 5)
    return [
        start,
        to(tail, 0),  # one byte is left
        to(tail, 1),  # two are left
        to(range(0xA0, 0xC0), 1),  # after E0: nothing that fits two bytes
        to(range(0x80, 0xA0), 1),  # after ED: no surrogates
        to(tail, 2),  # three are left
        to(range(0x90, 0xC0), 2),  # after F0: nothing that fits three bytes
        to(range(0x80, 0x90), 2),  # after F4: nothing above U+10FFFF
    ]


UTF8 = _utf8_machine()


class Utf8Stream:
    """Bytes in, whole characters out; bytes that are no UTF-8 become U+FFFD, as in ``bytes.decode("utf-8", "replace")``."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, chunk: bytes) -> str:
        raw = self.held + chunk
        end = len(raw)
        # Only the last three bytes can belong to an unfinished character: it begins at one of them.
        for at in range(max(0, end - 3), end):
            state = 0
            for b in raw[at:]:
                state = UTF8[state].get(b, -1)
                if state < 1:
                    break
            if state > 0:
                end = at
                break
        self.held = raw[end:]
        return raw[:end].decode("utf-8", "replace")

    def close(self) -> str:
        left, self.held = self.held, b""
        return left.decode("utf-8", "replace")
