"""Byte-level BPE as a lazily determinised finite-state transducer.

A tokenisation of a piece is the BPE one exactly if each token merges to itself and each pair of
neighbours, merged alone, stays that pair. That makes a nondeterministic transducer whose states are
(last finished token, place in the token trie). Every prefix has one BPE, so hypotheses differ only in
where their unfinished token starts. The subsets of the deterministic one are built as input needs
them; each tells the last token of the prefix that it has read. So the tokens before any place follow from
those that the walk has told on its way, and what the paths of all hypotheses share is settled: a token
leaves after a bounded lookahead, or, of a short piece, when the piece has ended. Finished pieces are remembered.
Short pieces of many texts are walked over together, a byte of each at a time, with the states in arrays.
"""

from __future__ import annotations

import base64
import contextlib
import re
import struct
import unicodedata
from array import array
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import takewhile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import bounded_batches, worker_cache


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_all(piece: bytes, ranks: dict[bytes, int], least: int = 1) -> list[int]:
    """The definition: merge the neighbours whose join has the least rank, leftmost first, until none or only `least` parts are left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > least:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes one piece of bytes at a time. max_states bounds the memory; beyond it the states are built anew."""

    #: Bytes of a piece that are walked over before what is settled leaves.
    BLOCK = 4096

    def __init__(self, ranks: dict[bytes, int], max_states: int = 80_000):
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {rank: token for token, rank in ranks.items()}
        #: A trie over the tokens: a node's child by node << 8 | byte, whether it has any, its depth, and the rank that ends there.
        self.children: dict[int, int] = {}
        self.inner, self.depth, self.ends = bytearray(1), array("H", [0]), [None]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                nxt = self.children.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.children[node << 8 | byte] = len(self.ends)
                    self.inner[node] = 1
                    self.inner.append(0)
                    self.depth.append(self.depth[node] + 1)
                    self.ends.append(None)
                node = nxt
            self.ends[node] = rank
        self.stable: dict[int, bool] = {}
        self.fits: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        #: Whether the halves of all tokens met so far rank before them, as in any trained vocabulary.
        self.ordered = True
        #: Subsets of last token + 1 << 32 | trie node, that whose last token has just ended last; that token; the next state by state << 8 | byte.
        self.states: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.last: list[int] = []
        self.steps: dict[int, int] = {}
        #: Of the last bytes streamed, tokens that weren't settled after each.
        self.pending: deque[tuple[int, ...]] = deque(maxlen=self.BLOCK)
        self._restart()

    def _restart(self) -> None:
        for held in (self.states, self.number, self.last, self.steps):
            held.clear()
        self._numbered((0,))

    def _numbered(self, subset: tuple[int, ...]) -> int:
        to = self.number.get(subset)
        if to is None:
            to = self.number[subset] = len(self.states)
            self.states.append(subset)
            self.last.append((subset[-1] >> 32) - 1)
        return to

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose join is the last merge of a token; None for a single byte."""
        found = self.halves.get(token, 0)
        if found == 0:
            whole, found = self.tokens[token], None
            if len(whole) > 1:
                parts = merge_all(whole, self.ranks, 2)
                found = parts[0], parts[1]
                self.ordered &= all(len(self.tokens[x]) == 1 or x < token for x in parts)
            self.halves[token] = found
        return found

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether two neighbours that each merge to one token don't merge across their border.

        Goes back in time from both whole tokens, undoing on either side of the border the merge that came
        later. At each moment the pieces at the border would join if their join had a lower rank than the merges
        that went on to use them; of equal ranks the one further left comes first.
        """
        left_until = right_until = 1 << 62
        tokens, ranks = self.tokens, self.ranks
        while True:
            joined = ranks.get(tokens[a] + tokens[b])
            if joined is not None and joined < left_until and joined <= right_until:
                return False
            left, right = self._halves(a), self._halves(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                left_until, a = a, left[1]
            else:
                right_until, b = b, right[0]

    def _may_follow(self, last: int, token: int) -> bool:
        ok = self.stable.get(token)
        if ok is None:
            ok = self.stable[token] = merge_all(self.tokens[token], self.ranks) == [token]
        if not ok or last < 0:
            return ok
        ok = self.fits.get(last << 32 | token)
        if ok is None:
            if len(self.fits) > self.max_states:
                self.fits.clear()
            ok = self._stay_apart(last, token)
            if not self.ordered:  # ranks that no training gives: by the definition
                ok = merge_all(self.tokens[last] + self.tokens[token], self.ranks) == [last, token]
            self.fits[last << 32 | token] = ok
        return ok

    def _step(self, state: int, byte: int) -> int:
        """The next state."""
        children, inner, ends, after, ended = self.children, self.inner, self.ends, [], None
        for member in self.states[state]:
            node = children.get((member & 0xFFFFFFFF) << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                after.append(member >> 32 << 32 | node)
            if ended is None:
                token = ends[node]
                if token is not None and self._may_follow((member >> 32) - 1, token):
                    ended = token
        after.append(ended + 1 << 32)
        subset = tuple(after)
        if len(self.states) >= self.max_states and subset not in self.number:
            self._restart()  # states are numbered anew; this step isn't kept
            return self._numbered(subset)
        self.steps[state << 8 | byte] = out = self._numbered(subset)
        return out

    def _ending(self, state: int, byte: int) -> int:
        """The last token after this byte."""
        for member in self.states[state]:
            node = self.children.get((member & 0xFFFFFFFF) << 8 | byte)
            token = None if node is None else self.ends[node]
            if token is not None and self._may_follow((member >> 32) - 1, token):
                return token
        raise ValueError("every byte must be a token")

    def _path(self, told: list[int], upto: int) -> list[int]:
        """The tokens of the first `upto` bytes, of which each told the last token that ends with it."""
        out, tokens = [], self.tokens
        while upto:
            out.append(told[upto - 1])
            upto -= len(tokens[out[-1]])
        return out[::-1]

    def _settled(self, told: list[int], state: int) -> tuple[int, ...]:
        """The tokens that the paths of all hypotheses share; their bytes leave `told`."""
        ends = sorted({len(told) - self.depth[member & 0xFFFFFFFF] for member in self.states[state]})
        shared = self._path(told, ends[0])
        for end in ends[1:]:
            shared = [a for a, _ in takewhile(lambda pair: pair[0] == pair[1], zip(shared, self._path(told, end), strict=False))]
        del told[: sum(len(self.tokens[token]) for token in shared)]
        return tuple(shared)

    def stream(self, piece: Iterable[int], every: int = 1) -> Iterator[tuple[int, ...]]:
        """Ids of a piece of any length; after every so many bytes those that are settled."""
        state, told, steps = 0, [], self.steps
        for read, byte in enumerate(piece, 1):
            following = steps.get(state << 8 | byte)
            state = self._step(state, byte) if following is None else following
            told.append(self.last[state])
            if read % every == 0:
                if settled := self._settled(told, state):
                    yield settled
                self.pending.append(tuple(self._path(told, len(told))))
        yield tuple(self._path(told, len(told)))

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is itself a token gives that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if not piece:
            return []
        if len(piece) > self.BLOCK:
            return [token for settled in self.stream(piece, self.BLOCK) for token in settled]
        state, told, steps, last = 0, [], self.steps, self.last
        for byte in piece[:-1]:
            following = steps.get(state << 8 | byte)
            state = self._step(state, byte) if following is None else following
            told.append(last[state])
        # of the whole piece only the last token is asked: few go on from there, so no state is made for it
        following = steps.get(state << 8 | piece[-1])
        told.append(self._ending(state, piece[-1]) if following is None else last[following])
        return self._path(told, len(told))


class Table:
    """Keys from 0 on to values from 0 on, open addressing in arrays; many are asked or added at once. -1: not there."""

    def __init__(self, bits: int = 12):
        self.bits, self.count = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.empty(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        held = self.keys[slots]
        hit = held == keys
        out = np.where(hit, self.values[slots], -1)
        left = np.flatnonzero(~hit & (held != -1))
        while left.size:
            slots[left] = at = slots[left] + 1 & (1 << self.bits) - 1
            held = self.keys[at]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (held != -1)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there."""
        if 2 * (self.count + len(keys)) > 1 << self.bits:
            there = self.keys != -1
            keys, values = np.concatenate([self.keys[there], keys]), np.concatenate([self.values[there], values])
            self.__init__((2 * len(keys)).bit_length() + 1)
        self.count += len(keys)
        slots, left = self._slots(keys), np.arange(len(keys))
        while left.size:
            free = left[self.keys[slots[left]] == -1]
            self.keys[slots[free]] = keys[free]  # of keys that meet in a slot one stays
            mine = self.keys[slots[left]] == keys[left]
            self.values[slots[left[mine]]] = values[left[mine]]
            left = left[~mine]
            slots[left] = slots[left] + 1 & (1 << self.bits) - 1


class _Rows:
    """An array that rows are put to the end of."""

    def __init__(self, kind: type):
        self.array, self.size = np.empty(1 << 12, kind), 0

    def extend(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.array):
            self.array = np.concatenate([self.array[: self.size], np.empty(self.size + 2 * len(more), self.array.dtype)])
        self.array[self.size : self.size + len(more)] = more
        self.size += len(more)


class Lockstep:
    """The transducer's walk over many pieces together, a byte of each at a time.

    States are the transducer's subsets, in arrays; the steps that no piece has taken before are worked out together. Beyond
    the transducer's max_states they are built anew, before the next walk; a walk adds BYTES at most.
    """

    #: Bytes of pieces that are walked over together.
    BYTES = 1 << 18

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        ranks, many = transducer.ranks, max(transducer.tokens) + 1
        self.length = np.zeros(many, np.int64)
        for rank, token in transducer.tokens.items():
            self.length[rank] = len(token)
        self.inner = np.frombuffer(bytes(transducer.inner), np.bool_)
        self.ends = np.array([-1 if rank is None else rank for rank in transducer.ends], np.int64)
        self.children, self.joins = Table(), Table()
        self.children.add(*(np.fromiter(x, np.int64) for x in (transducer.children, transducer.children.values())))
        pairs, joined = array("q"), array("q")
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    joined.append(rank)
        self.joins.add(np.array(pairs, np.int64), np.array(joined, np.int64))
        #: By token: its halves (-1: a single byte) and whether it merges to itself; -2 is not known yet.
        self.left, self.right, self.stable = (np.full(many, -2, kind) for kind in (np.int64, np.int64, np.int8))
        self._restart()

    def _restart(self) -> None:
        #: Members of the subsets, one after another; where each begins; the last token of each.
        self.members, self.begins, self.last = _Rows(np.int64), _Rows(np.int64), _Rows(np.int64)
        self.number: dict[bytes, int] = {}
        self.steps = Table()
        self._numbered(np.zeros(1, np.int64), np.ones(1, np.int64))

    def _numbered(self, members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of subsets that lie one after another."""
        stops = np.cumsum(sizes)
        packed, out, new, start, number = members.tobytes(), [], [], 0, self.number
        for i, stop in enumerate((8 * stops).tolist()):
            subset, start = packed[start:stop], stop
            to = number.get(subset)
            if to is None:
                to = number[subset] = len(number)
                new.append(i)
            out.append(to)
        many = sizes[new]
        first = np.cumsum(many) - many
        rows = np.repeat((stops - sizes)[new] - first, many) + np.arange(many.sum())
        self.begins.extend(self.members.size + first)
        self.members.extend(members[rows])
        self.last.extend((members[stops[new] - 1] >> 32) - 1)
        return np.array(out, np.int64)

    def _known_halves(self, tokens: np.ndarray) -> None:
        for token in np.unique(tokens[self.left[tokens] == -2]).tolist():
            self.left[token], self.right[token] = self.transducer._halves(token) or (-1, -1)

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As of the transducer, of many pairs."""
        out, pairs = np.ones(len(a), np.bool_), np.arange(len(a))
        left_until = right_until = np.full(len(a), 1 << 62)
        while pairs.size:
            joined = self.joins.get(a << 32 | b)
            meet = (joined >= 0) & (joined < left_until) & (joined <= right_until)
            out[pairs[meet]] = False
            self._known_halves(a)
            self._known_halves(b)
            left, right = self.right[a], self.left[b]
            go = ~meet & ((left >= 0) | (right >= 0))
            undo = (right < 0) | (left >= 0) & (a > b)
            left_until, right_until = np.where(undo, a, left_until)[go], np.where(undo, right_until, b)[go]
            a, b, pairs = np.where(undo, left, a)[go], np.where(undo, b, right)[go], pairs[go]
        return out

    def _may_follow(self, last: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        pairs, back = np.unique(last + 1 << 32 | tokens, return_inverse=True)
        last, tokens = (pairs >> 32) - 1, pairs & 0xFFFFFFFF
        for token in np.unique(tokens[self.stable[tokens] == -2]).tolist():
            self.stable[token] = self.transducer._may_follow(-1, token)
        ok = self.stable[tokens] == 1
        asked = np.flatnonzero(ok & (last >= 0))
        ok[asked] = self._stay_apart(last[asked], tokens[asked])
        if not self.transducer.ordered:  # by the definition
            ok = np.array([self.transducer._may_follow(a, b) for a, b in zip(last.tolist(), tokens.tolist(), strict=True)], np.bool_)
        return ok[back]

    def _ended(self, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of steps (state << 8 | byte): the last token after each; which step each member comes of, its last token + 1 and its place in the trie."""
        states, begins = steps >> 8, self.begins.array
        stops = np.where(states + 1 < self.begins.size, begins[np.minimum(states + 1, self.begins.size - 1)], self.members.size)
        many = stops - begins[states]
        of = np.repeat(np.arange(len(steps)), many)
        members = self.members.array[np.repeat(begins[states] - (np.cumsum(many) - many), many) + np.arange(len(of))]
        nodes = self.children.get((members & 0xFFFFFFFF) << 8 | (steps & 0xFF)[of])
        there = nodes >= 0
        of, last, nodes = of[there], members[there] >> 32, nodes[there].astype(np.int64)
        tokens = self.ends[nodes]
        whole = np.flatnonzero(tokens >= 0)
        fit = whole[self._may_follow(last[whole] - 1, tokens[whole])]
        found, first = np.unique(of[fit], return_index=True)
        if len(found) < len(steps):
            raise ValueError("every byte must be a token")
        return tokens[fit[first]], of, last, nodes

    def _step(self, steps: np.ndarray) -> np.ndarray:
        """The next states of steps that weren't taken before."""
        ended, of, last, nodes = self._ended(steps)
        on = self.inner[nodes]
        of, after = of[on], last[on] << 32 | nodes[on]
        sizes = np.bincount(of, minlength=len(steps)) + 1
        members, tails = np.empty(len(after) + len(steps), np.int64), np.cumsum(sizes) - 1
        members[tails] = ended + 1 << 32
        members[np.arange(len(after)) + of] = after  # before it are as many tails as steps
        out = self._numbered(members, sizes)
        self.steps.add(steps, out)
        return out

    def _walk(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.number) >= self.transducer.max_states:
            self._restart()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        at, data = starts[order], np.frombuffer(b"".join(pieces), np.uint8)
        told, states = np.empty(len(data), np.int64), np.zeros(len(pieces), np.int64)
        longer = np.searchsorted(-sizes[order], -np.arange(sizes.max() + 1)).tolist()
        for place, (here, on) in enumerate(zip(longer, longer[1:], strict=False)):
            where = at[:here] + place
            steps = states[:here] << 8 | data[where]
            to = self.steps.get(steps).astype(np.int64)
            for span in (slice(0, on), slice(on, here)):
                unknown = np.flatnonzero(to[span] < 0)
                last = self.last.array[np.maximum(to[span], 0)]
                if unknown.size:
                    new, back = np.unique(steps[span][unknown], return_inverse=True)
                    if span.stop == on:
                        to[unknown] = got = self._step(new)[back]
                        last[unknown] = self.last.array[got]
                    else:  # of a whole piece only the last token is asked
                        last[unknown] = self._ended(new)[0][back]
                told[where[span]] = last
            states = to[:on]
        # backwards: where the tokens end
        marked, piece, upto = np.zeros(len(data), np.bool_), starts, starts + sizes
        while piece.size:
            marked[upto - 1] = True
            upto = upto - self.length[told[upto - 1]]
            more = upto > piece
            piece, upto = piece[more], upto[more]
        packed = told[marked].astype("<u4").tobytes()
        stops = (4 * np.cumsum(marked)[starts + sizes - 1]).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces that aren't empty, each as the transducer's."""
        out, start, held = [], 0, 0
        for i, piece in enumerate(pieces):
            if held + len(piece) > self.BYTES and i > start:
                out += self._walk(pieces[start:i])
                start, held = i, 0
            held += len(piece)
        if start < len(pieces):
            out += self._walk(pieces[start:])
        ranks = self.transducer.ranks
        return [ids if (whole := ranks.get(piece)) is None else struct.pack("<I", whole) for piece, ids in zip(pieces, out, strict=True)]


class _Pieces(dict):
    """Packed ids by piece of text, in two generations: what is in use survives when the older one goes."""

    def __init__(self, ranks: dict[bytes, int], most: int = 80_000, longest: int = 64):
        super().__init__()
        self.transducer, self.most, self.longest = Transducer(ranks), most, longest
        self.lockstep = Lockstep(self.transducer)
        self.older: dict[str, bytes] = {}

    def learn(self, pieces: Iterable[str]) -> None:
        """Hold these pieces, those not known yet walked over together; longer ones are left out."""
        if len(self) >= self.most:
            self._age()
        new, older = [], self.older
        for piece in pieces:
            if piece not in self and len(piece) <= self.longest:
                if (packed := older.get(piece)) is None:
                    new.append(piece)
                else:
                    self[piece] = packed
        self.update(zip(new, self.lockstep.encode([piece.encode() for piece in new]), strict=True))

    def _age(self) -> None:
        self.older = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = self.transducer.encode(piece.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self._age()
            self[piece] = packed
        return packed


#: White space as Unicode's White_Space property has it (fixed values); Python's own class has four controls more.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache
def _ranges(major: str) -> str:
    """The code points of a general category's group, as ranges for a character class."""
    out, start = [], None
    for code in range(0x110001):
        inside = code < 0x110000 and unicodedata.category(chr(code))[0] == major
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


@lru_cache
def compile_pattern(pattern: str) -> re.Pattern:
    """A splitting pattern with \\p{L}, \\p{N}, \\s and \\S, for Python's own matcher, which is many times faster here."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        two, five = pattern[at : at + 2], pattern[at : at + 5]
        if five in (r"\p{L}", r"\p{N}") or two == r"\s":
            found = WHITE_SPACE if two == r"\s" else _ranges(five[3])
            out.append(found if inside else f"[{found}]")
            at += 2 if two == r"\s" else 5
            continue
        if two == r"\S" and not inside:
            out.append(f"[^{WHITE_SPACE}]")
            at += 2
            continue
        if two[0] == "\\":
            out.append(two)
            at += 2
            continue
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        out.append(pattern[at])
        at += 1
    return re.compile("".join(out))


@lru_cache
def _common_pattern(pattern: str) -> re.Pattern:
    """The pattern with Python's own classes, equal to it on texts without _odd() characters and four times faster."""
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    return re.compile(plain)


@lru_cache
def _odd() -> frozenset[str]:
    """Characters whose class differs between Python's matcher and Unicode's categories."""
    space = re.compile(f"[{WHITE_SPACE}]")
    out = []
    for char in map(chr, range(0x110000)):
        major, word, digit = unicodedata.category(char)[0], char.isalnum(), char.isdecimal()
        if (major == "L") != (word and not digit) or (major == "N") != digit or char.isspace() != bool(space.match(char)):
            out.append(char)
    return frozenset(out)


class Encoder:
    """Whole texts to packed ids: little-endian unsigned 32-bit integers."""

    #: Characters of texts whose pieces are looked at together.
    CHARS = 1 << 19

    def __init__(self, ranks_path: str, pattern: str):
        self.pieces = _Pieces(load_ranks(ranks_path))
        self.exact, self.common, self.odd = compile_pattern(pattern), _common_pattern(pattern), _odd()

    def _split(self, text: str | None) -> list[str]:
        return (self.common if self.odd.isdisjoint(text) else self.exact).findall(text) if text else []

    def __call__(self, text: str | None) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self._split(text)))

    def all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text in turn."""
        held, chars = [], 0
        for text in texts:
            held.append(self._split(text))
            chars += len(text or "")
            if chars >= self.CHARS:
                yield from self._joined(held)
                held, chars = [], 0
        yield from self._joined(held)

    def _joined(self, split: list[list[str]]) -> Iterator[bytes]:
        self.pieces.learn(set().union(*split))
        for pieces in split:
            yield b"".join(map(self.pieces.__getitem__, pieces))


class Utf8Stream:
    """Incremental UTF-8: feed bytes cut anywhere, get the text of all complete characters.

    A state machine by byte. The state is (bits read so far, continuation bytes that lack, least and
    largest next byte); START has none. Bytes that can't be UTF-8 become U+FFFD, one for each longest run
    that could have begun a character; `valid` then turns false, and so it does if finish() finds a
    character cut short.
    """

    START = (0, 0, 0x80, 0xBF)
    #: Second bytes that a lead byte narrows, so that no character has two encodings and none is a surrogate.
    NARROW = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}

    def __init__(self) -> None:
        self.state, self.valid = self.START, True

    @classmethod
    def step(cls, state: tuple, byte: int) -> tuple[str, tuple, bool]:
        """(text, next state, whether the byte was allowed)."""
        bits, lack, low, high = state
        if lack:
            if low <= byte <= high:
                bits = bits << 6 | byte & 0x3F
                return ("", (bits, lack - 1, 0x80, 0xBF), True) if lack > 1 else (chr(bits), cls.START, True)
            text, state, _ = cls.step(cls.START, byte)
            return "\ufffd" + text, state, False
        if byte < 0x80:
            return chr(byte), cls.START, True
        lack = 1 if 0xC2 <= byte <= 0xDF else 2 if 0xE0 <= byte <= 0xEF else 3 if 0xF0 <= byte <= 0xF4 else 0
        if not lack:
            return "\ufffd", cls.START, False
        return "", (byte & (0x3F >> lack), lack, *cls.NARROW.get(byte, (0x80, 0xBF))), True

    @classmethod
    def run(cls, state: tuple, data: bytes) -> tuple[str, tuple, bool]:
        out, fine = [], True
        for byte in data:
            text, state, ok = cls.step(state, byte)
            fine &= ok
            out.append(text)
        return "".join(out), state, fine

    def feed(self, data: bytes) -> str:
        if self.state == self.START and data.isascii():
            return data.decode()
        text, self.state, fine = self.run(self.state, data)
        self.valid &= fine
        return text

    def finish(self) -> str:
        cut, self.state = self.state != self.START, self.START
        self.valid &= not cut
        return "\ufffd" if cut else ""


class Decoder:
    """Packed ids back to text, in chunks of ids.

    A token moves the UTF-8 machine from one state to another and gives some text: a transition that is
    worked out when it is first met. Tokens of whole characters lead from the start to the start, so a
    chunk of such tokens is a join.
    """

    def __init__(self, ranks_path: str, chunk: int = 1024, tokens: dict[int, bytes] | None = None):
        self.tokens = tokens or {rank: token for token, rank in load_ranks(ranks_path).items()}
        self.chunk = chunk
        self.moves: dict[tuple, tuple[str, tuple, bool]] = {}
        self.whole: dict[int, str] = {}
        for rank, token in self.tokens.items():
            with contextlib.suppress(UnicodeDecodeError):
                self.whole[rank] = token.decode()

    def stream(self, packed: bytes | None, stream: Utf8Stream) -> Iterator[str]:
        """Texts of chunks of ids; the machine in `stream` goes from one to the next."""
        packed = packed or b""
        for at in range(0, len(packed), 4 * self.chunk):
            part = packed[at : at + 4 * self.chunk]
            ids = struct.unpack(f"<{len(part) // 4}I", part)
            if stream.state == stream.START:
                try:
                    yield "".join(map(self.whole.__getitem__, ids))
                    continue
                except KeyError:  # a token with part of a character
                    pass
            out = []
            for token in ids:
                move = self.moves.get((stream.state, token))
                if move is None:
                    if len(self.moves) >= 200_000:
                        self.moves.clear()
                    move = self.moves[stream.state, token] = stream.run(stream.state, self.tokens[token])
                text, stream.state, fine = move
                stream.valid &= fine
                out.append(text)
            yield "".join(out)

    def text(self, packed: bytes | None) -> tuple[str, bool]:
        stream = Utf8Stream()
        out = [*self.stream(packed, stream), stream.finish()]
        return "".join(out), stream.valid


def _codec(ranks_path: str, pattern: str) -> tuple[Encoder, Decoder]:
    def both() -> tuple[Encoder, Decoder]:
        encoder = Encoder(ranks_path, pattern)
        return encoder, Decoder(ranks_path, tokens=encoder.pieces.transducer.tokens)

    return worker_cache("bpe", (ranks_path, pattern), both)


def encode(text: Column, ranks_path: str, pattern: str) -> Column:
    """Ids of a text column as BINARY, packed as little-endian unsigned 32-bit integers.

    Null and empty texts give no ids (empty binary). The rank file must lie at ranks_path on every
    executor. No special tokens; their strings are ordinary text.
    """

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        encoder = _codec(ranks_path, pattern)[0]
        return pd.Series(list(encoder.all(texts)), dtype=object)

    return ids(text)


def decode(ids: Column, ranks_path: str, pattern: str) -> Column:
    """Text of packed ids. Null gives an empty text; bytes that aren't UTF-8 become U+FFFD."""

    @F.pandas_udf("string")
    def texts(packed: pd.Series) -> pd.Series:
        decoder = _codec(ranks_path, pattern)[1]
        return pd.Series([decoder.text(x)[0] for x in packed], dtype=object)

    return texts(ids)


def tokenize(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the packed ids of `text` and the text decoded from them; columns of those names are replaced.

    Each row stands alone: nothing is shuffled, repeated rows stay, an empty table gives an empty one.
    One pass: a worker encodes a batch and decodes the ids it got.
    """
    bounded_batches(df.sparkSession)
    plain = df.drop(ids, decoded)
    at = plain.columns.index(text)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _codec(ranks_path, pattern)
        for batch in batches:
            packed = list(encoder.all(batch.column(at).to_pylist()))
            texts = [decoder.text(x)[0] for x in packed]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary()), pa.array(texts, pa.string())], names=[*batch.schema.names, ids, decoded])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(both, f"{kinds}, `{ids}` binary, `{decoded}` string")
