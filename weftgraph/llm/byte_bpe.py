"""Byte-level BPE: encoding by a lazily determinised finite-state transducer, decoding by an incremental UTF-8 state machine.

Encoding rests on two facts about merging by lowest rank: the tokens of a text's prefix are a prefix of its tokens wherever a token ends there, and a
sequence of tokens is an encoding exactly if each adjacent pair encodes to itself. So every prefix of the input has one last token: the suffix that is a token and
goes with the last token of what lies before it. A state of the transducer is the last committed token and the bytes read since, with
the last token at each place among them. A byte leads to the next state, made when it is first needed; tokens on which all places agree at which a longer token may still begin
are emitted at once. No token begins further back than the longest token is long, so lookahead is bounded.

The transducer is made lazily, as far as the texts need it. The new pieces of many texts go through it together (Machine): they take a byte at a time, and transitions that none has taken before are determinised all at once and
stay for the pieces to come; when its tables are full they are emptied and fill up anew. A single piece (Transducer.encode: very long ones, or other patterns) takes a state at a time; there a transition becomes part of the transducer
when it is needed for the second time and there is room, and until then the rest of the piece is left to the machine before it is determinised: at each place the longest token that ends there and goes with the last token at the
place where it begins. So a worker's memory is bounded, whatever the texts and however long a piece is.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import cache, cached_property, partial
from itertools import chain, islice

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import Kept, bound_batches, give_back

#: Pieces met more than once whose tokens a worker remembers, in each of two generations; pieces met once; states that the transducer may have.
MEMO_PIECES, MEMO_MET = 150_000, 100_000
MEMO_STATES = 20_000
#: Pairs of tokens of which a worker remembers whether they stay apart, one by one and (a power of two, twice as many as there may be) for many pieces at once.
MEMO_PAIRS, PAIR_SLOTS = 20_000, 1 << 20
#: Bytes of the longest piece that is read with others, and characters of texts whose words are told apart together; states of the machine that reads them, and pieces that go through it together.
LONG_PIECE, BATCH_CHARS = 32, 8_000_000
MACHINE_STATES, MACHINE_PIECES = 1 << 17, 8_192


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 bytes and a number."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge_all(ranks: dict[bytes, int], piece: bytes) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
    """Merges by lowest rank, the leftmost first; the parts that remain and, for each merge, its rank and the parts then at either end."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    done = []
    while len(parts) > 1:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        if not found:
            break
        r, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        done.append((r, parts[0], parts[-1]))
    return parts, done


class _State:
    """The last committed token (-1: none), the bytes since, the last token at each place among these, and the live places: those at which a token may still begin or end."""

    __slots__ = ("before", "lasts", "live", "next", "window")

    def __init__(self, before: int, window: bytes, lasts: tuple[int, ...], live: tuple[int, ...]) -> None:
        self.before, self.window, self.lasts, self.live = before, window, lasts, live
        self.next: dict[int, tuple[_State, list[int]] | None] = {}  # None: met once


class _Pairs:
    """Which pairs of tokens stay apart, for many at once: a table with open addressing, emptied when it is half full."""

    def __init__(self) -> None:
        self.keys, self.fits, self.held = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(40)).astype(np.int64) & (PAIR_SLOTS - 1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair fits, and the places of those not known."""
        slots, fits = self._slots(keys), np.zeros(len(keys), bool)
        open_, unknown = np.arange(len(keys)), []
        while len(open_):
            there = self.keys[slots[open_]]
            hit = there == keys[open_]
            fits[open_[hit]] = self.fits[slots[open_[hit]]]
            unknown.append(open_[there < 0])
            open_ = open_[~hit & (there >= 0)]
            slots[open_] = (slots[open_] + 1) & (PAIR_SLOTS - 1)
        return fits, np.concatenate(unknown) if unknown else open_

    def add(self, keys: np.ndarray, fits: np.ndarray) -> None:
        """Notes different pairs that aren't known; of more than there is room for, the first."""
        if self.held + len(keys) > PAIR_SLOTS // 2:
            self.keys[:], self.held = -1, 0
        keys, fits = keys[: PAIR_SLOTS // 2], fits[: PAIR_SLOTS // 2]
        self.held += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of two that want one place the later has it
            won = self.keys[slots] == keys
            self.fits[slots[won]] = fits[won]
            keys, fits, slots = keys[~won], fits[~won], (slots[~won] + 1) & (PAIR_SLOTS - 1)


class Transducer:
    """Bytes in, token ids out, with bounded lookahead."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self._bytes = {rank: t for t, rank in ranks.items()}
        self._lens = {rank: len(t) for t, rank in ranks.items()}
        #: How tokens come about by merging, for those that do: the merges of a rank are from _merge_at[rank] to _merge_at[rank + 1]; of each its rank, and the tokens then at either end.
        self._merge_at, self._merge_rank, self._merge_begin, self._merge_end = array("I", (0,)), array("I"), array("I"), array("I")
        self._merged = array("I")
        for rank in range(max(ranks.values()) + 1):
            parts, done = merge_all(ranks, self._bytes[rank]) if rank in self._bytes else ([], [])
            if len(parts) == 1:
                self._merged.append(rank)
                self._merge_rank.extend(r for r, _, _ in done)
                self._merge_begin.extend(ranks[first] for _, first, _ in done)
                self._merge_end.extend(ranks[last] for _, _, last in done)
            self._merge_at.append(len(self._merge_rank))
        self._goes: dict[int, bool] = {}
        # beginnings of tokens as nodes, for many pieces at once: node * 256 + byte -> node
        kinds = self._beginnings()
        nodes = {prefix: i for i, prefix in enumerate(kinds)}
        edges = np.fromiter((nodes[x[:-1]] * 256 + x[-1] if len(x) > 1 else -1 for x in kinds), np.int64, len(kinds))
        self._to = np.argsort(edges)[int((edges < 0).sum()) :]
        self._edges = edges[self._to]
        kind = np.fromiter(kinds.values(), np.int64, len(kinds))
        self._token, self._longer = np.where(kind & 2, kind >> 2, -1), (kind & 1).astype(bool)
        self._first = np.array([nodes[bytes((b,))] for b in range(256)], np.int64)
        self._sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self._sizes[list(self._lens)] = list(self._lens.values())
        self._pairs = _Pairs()
        # what two tokens make together: left << 20 | right -> rank, sorted; and, as arrays, what _apart reads
        made = {ranks[t[:k]] << 20 | ranks[t[k:]]: rank for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self._joins = np.fromiter(made, np.int64, len(made))
        order = np.argsort(self._joins)
        self._joins, self._joined = self._joins[order], np.fromiter(made.values(), np.int64, len(made))[order].astype(np.int32)
        single = np.array([ranks[bytes((b,))] for b in range(256)], np.int32)
        self._ends_in, self._begins_with = np.zeros(len(self._sizes), np.int32), np.zeros(len(self._sizes), np.int32)
        known = np.fromiter(ranks.values(), np.int64, len(ranks))
        self._ends_in[known], self._begins_with[known] = single[[t[-1] for t in ranks]], single[[t[0] for t in ranks]]
        self.start = _State(-1, b"", (), (0,))
        self.states = {(-1, b""): self.start}

    def _beginnings(self) -> dict[bytes, int]:
        """For each beginning of a token: 4 * rank + 2 if it is a token, + 1 if a longer one begins so."""
        kinds: dict[bytes, int] = {}
        for rank in self._merged:
            t = self._bytes[rank]
            kinds[t] = kinds.get(t, 0) | 4 * rank | 2
            for i in range(1, len(t)):
                kinds[t[:i]] = kinds.get(t[:i], 0) | 1
        return kinds

    @cached_property
    def kinds(self) -> dict[bytes, int]:
        """_beginnings(), made for the first piece that takes a state at a time."""
        return self._beginnings()

    @cached_property
    def _ends(self) -> Callable[[str], Iterator[tuple[int, tuple[int, int]]]]:
        """The tokens that end at each place, made for the first piece that is simulated."""
        tokens = ahocorasick.Automaton()
        for rank in self._merged:
            tokens.add_word(self._bytes[rank].decode("latin-1"), (rank, self._lens[rank]))
        tokens.make_automaton()
        return tokens.iter

    def _apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b side by side encode to themselves: no merge across their boundary ever comes first."""
        left, right, at, rank_of, never = self._bytes[a], self._bytes[b], self._merge_at, self._merge_rank, max(self._sizes.size, len(self.ranks)) + 1
        end, begin, i, j, n, m = left[-1:], right[:1], at[a], at[b], at[a + 1], at[b + 1]
        while True:
            across = self.ranks.get(end + begin, never)
            ours = rank_of[i] if i < n else never
            theirs = rank_of[j] if j < m else never
            if across < ours and across <= theirs:
                return False
            if ours == theirs == never:
                return True
            if ours <= theirs:
                end, i = self._bytes[self._merge_end[i]], i + 1
            else:
                begin, j = self._bytes[self._merge_begin[j]], j + 1

    def _apart_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_apart() of many pairs together."""
        at, never = np.frombuffer(self._merge_at, np.uint32), max(self._sizes.size, len(self.ranks)) + 1
        rank_of, ends, begins = (np.frombuffer(x, np.uint32) for x in (self._merge_rank, self._merge_end, self._merge_begin))
        fits, rows, last, most = np.ones(len(a), bool), np.arange(len(a)), len(rank_of) - 1, len(self._joins) - 1
        if last < 0:
            return fits
        i, n, j, m = (at[x].astype(np.int64) for x in (a, a + 1, b, b + 1))
        end, begin = self._ends_in[a].astype(np.int64), self._begins_with[b].astype(np.int64)
        while len(rows):
            both = end << 20 | begin
            found = np.minimum(np.searchsorted(self._joins, both), most)
            across = np.where(self._joins[found] == both, self._joined[found], never)
            mine, theirs = np.minimum(i, last), np.minimum(j, last)
            ours_next, theirs_next = np.where(i < n, rank_of[mine], never), np.where(j < m, rank_of[theirs], never)
            bad = (across < ours_next) & (across <= theirs_next)
            fits[rows[bad]] = False
            left = ours_next <= theirs_next
            end, begin = np.where(left, ends[mine], end), np.where(left, begin, begins[theirs])
            i, j = i + left, j + ~left
            go = ~bad & (np.minimum(ours_next, theirs_next) < never)
            rows, i, n, j, m, end, begin = (x[go] for x in (rows, i, n, j, m, end, begin))
        return fits

    def _fits(self, left: int, token: int) -> bool:
        if len(self._goes) >= MEMO_PAIRS:
            self._goes.clear()
        fits = self._goes[left << 20 | token] = self._apart(left, token)
        return fits

    def _read(self, state: _State, data: bytes, upto: int) -> tuple[list[int], list[int]]:
        """From a state whose window begins data: the last tokens at all places up to `upto`, and the live places there."""
        kind_of, goes, before = self.kinds.get, self._goes.get, state.before
        lasts, live = list(state.lasts), state.live
        for n in range(len(state.window) + 1, upto + 1):
            last, then = -1, []
            for i in live:
                kind = kind_of(data[i:n])
                if kind is None:
                    continue
                if kind & 2 and last < 0:
                    token = kind >> 2
                    left = lasts[i - 1] if i else before
                    # exactly one token fits; if none of the longer ones did, it is the single byte
                    if left < 0 or i == n - 1:
                        last = token
                    else:
                        fits = goes(left << 20 | token)
                        if fits is None:
                            fits = self._fits(left, token)
                        if fits:
                            last = token
                if kind & 1:
                    then.append(i)
            lasts.append(last)
            then.append(n)
            live = then
        return lasts, live

    def _back(self, lasts: list[int] | tuple[int, ...], at: int) -> list[int]:
        """The tokens that end at a place."""
        out, lens = [], self._lens
        while at:
            token = lasts[at - 1]
            out.append(token)
            at -= lens[token]
        return out[::-1]

    def step(self, state: _State, byte: int) -> tuple[_State, list[int]]:
        """The next state, and the tokens that are certain by then."""
        if found := state.next.get(byte):
            return found
        window = state.window + bytes((byte,))
        lasts, live = self._read(state, window, len(window))
        # the paths of tokens to all live places share a beginning, which is certain: it ends where they meet, going back
        ends = set(live)
        while len(ends) > 1:
            far = max(ends)
            ends.remove(far)
            ends.add(far - self._lens[lasts[far - 1]])
        (sure,) = ends
        key = (lasts[sure - 1] if sure else state.before, window[sure:])
        if (then := self.states.get(key)) is None:
            then = self.states[key] = _State(*key, tuple(lasts[sure:]), tuple(i - sure for i in live))
        found = state.next[byte] = then, self._back(lasts, sure)
        return found

    def flush(self, state: _State) -> list[int]:
        """The tokens of the bytes not yet committed."""
        return self._back(state.lasts, len(state.window))

    def simulate(self, state: _State, rest: bytes) -> list[int]:
        """The tokens not yet committed in a state, followed by `rest` to the end of the piece, without states."""
        goes = self._goes.get
        lasts, done = [state.before, *state.lasts], len(state.window)  # the last token at each place
        add = lasts.append
        data = state.window + rest
        # of the tokens that end at a place, the longest comes first; exactly one fits
        for end, (token, size) in self._ends(data.decode("latin-1")):
            if end < done:
                continue
            if size > 1:
                left = lasts[end + 1 - size]
                if left >= 0:
                    fits = goes(left << 20 | token)
                    if fits is None:
                        fits = self._fits(left, token)
                    if not fits:
                        continue
            add(token)
            done = end + 1
        return self._back(lasts[1:], len(data))

    def _fit_all(self, left: np.ndarray, token: np.ndarray) -> np.ndarray:
        keys = left << 20 | token
        fits, unknown = self._pairs.find(keys)
        if len(unknown):
            new, at = np.unique(keys[unknown], return_inverse=True)
            told = self._apart_all(new >> 20, new & 0xFFFFF)
            self._pairs.add(new, told)
            fits[unknown] = told[at]
        return fits

    def encode(self, piece: bytes) -> list[int]:
        out: list[int] = []
        state = self.start
        for at, byte in enumerate(piece):
            found = state.next.get(byte)
            if not found:
                if byte not in state.next or len(self.states) >= MEMO_STATES:
                    if len(self.states) < MEMO_STATES:
                        state.next[byte] = None
                    return out + self.simulate(state, piece[at:])
                found = self.step(state, byte)
            state = found[0]
            if found[1]:
                out += found[1]
        return out + self.flush(state)


class Machine:
    """The transducer for many pieces of at most LONG_PIECE bytes at once. States are rows of tables: the token committed before, the bytes since, the last token at each place among them, and the node (a beginning of tokens) that leads from
    each live place to the end. All pieces take a byte at a time; transitions that none has taken yet are determinised together. When the tables fill up they are emptied, and made anew as far as they are needed."""

    def __init__(self, transducer: Transducer, states: int | None = None) -> None:
        self.t, self.most = transducer, states or MACHINE_STATES
        w = LONG_PIECE
        self.before, self.size = np.zeros(self.most, np.int32), np.zeros(self.most, np.int32)
        self.window, self.lasts, self.nodes = np.zeros((self.most, w), np.uint8), np.zeros((self.most, w), np.int32), np.full((self.most, w), -1, np.int32)
        self.keys, self.to = np.full(4 * self.most, -1, np.int64), np.zeros(4 * self.most, np.int32)
        self.out_at, self.out_n = np.zeros(4 * self.most, np.int32), np.zeros(4 * self.most, np.int32)
        #: Bytes that were read by transitions, and those that were simulated as the tables had no room left within a batch.
        self.read, self.simulated = 0, 0
        self._clear()

    def _clear(self) -> None:
        self.keys[:] = -1
        self.before[0], self.size[0] = -1, 0
        self.states, self.held, self.out = {self._name(np.array([-1]), np.array([0]), self.window[:1])[0]: 0}, 0, array("I")

    @staticmethod
    def _name(before: np.ndarray, size: np.ndarray, window: np.ndarray) -> list[bytes]:
        rows = np.concatenate([before.astype("<i4")[:, None].view(np.uint8), size.astype(np.uint8)[:, None], window], axis=1)
        data, n = np.ascontiguousarray(rows).tobytes(), rows.shape[1]
        return [data[i : i + n] for i in range(0, len(data), n)]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of transitions, and which aren't there."""
        mask = len(self.keys) - 1
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & mask
        there = self.keys[at]
        off = np.flatnonzero((there != keys) & (there >= 0))
        while len(off):
            at[off] = (at[off] + 1) & mask
            there = self.keys[at[off]]
            off = off[(there != keys[off]) & (there >= 0)]
        return at, self.keys[at] < 0

    def _add(self, keys: np.ndarray, to: np.ndarray, out_at: np.ndarray, out_n: np.ndarray) -> None:
        left = np.arange(len(keys))
        while len(left):
            at, _ = self._find(keys[left])
            self.keys[at] = keys[left]  # of two that want one place the later has it
            won = self.keys[at] == keys[left]
            mine, at = left[won], at[won]
            self.to[at], self.out_at[at], self.out_n[at] = to[mine], out_at[mine], out_n[mine]
            left = left[~won]
        self.held += len(keys)

    def _grow(self, keys: np.ndarray) -> bool:
        """Determinises transitions (state * 256 + byte), none of which is there; False if there is no room."""
        t, many = self.t, len(keys)
        if len(self.states) + many > self.most or self.held + many > 2 * self.most:
            return False
        s, byte = keys >> 8, keys & 255
        size, rows = self.size[s].astype(np.int64), np.arange(many)
        width = int(size.max()) + 1  # of what has been read since, the new byte included
        window, lasts, before = np.zeros((many, width), np.uint8), np.zeros((many, width), np.int64), self.before[s].astype(np.int64)
        window[:, : width - 1], lasts[:, : width - 1] = self.window[s, : width - 1], self.lasts[s, : width - 1]
        window[rows, size] = byte
        # where the tokens that may begin at live places go with the new byte
        nodes = np.full((many, width), -1, np.int64)
        x, y = np.nonzero(self.nodes[s, : width - 1] >= 0)
        edge = self.nodes[s[x], y].astype(np.int64) * 256 + byte[x]
        found = np.minimum(np.searchsorted(t._edges, edge), len(t._edges) - 1)
        goes = t._edges[found] == edge
        nodes[x[goes], y[goes]] = t._to[found[goes]]
        single = t._first[byte]
        # of the tokens that end here the longest that goes with the last token before it; else the single byte
        x, y = x[goes], y[goes]
        token = t._token[nodes[x, y]]
        x, y, token = x[token >= 0], y[token >= 0], token[token >= 0]
        left = np.where(y > 0, lasts[x, np.maximum(y - 1, 0)], before[x])
        fits = left < 0
        fits[~fits] = t._fit_all(left[~fits], token[~fits])
        last = t._token[single]
        first, at = np.unique(x[fits], return_index=True)
        last[first] = token[fits][at]
        lasts[rows, size] = last
        nodes[rows, size] = single
        nodes[(nodes >= 0) & ~t._longer[np.maximum(nodes, 0)]] = -1
        # the paths of tokens to all live places share a beginning: it ends where they meet, going back
        ends = np.zeros((many, width + 1), bool)
        ends[:, :width] = nodes >= 0
        ends[rows, size + 1] = True
        count = ends.sum(1)
        for far in range(width, 0, -1):
            back = np.flatnonzero(ends[:, far] & (count > 1))
            if len(back):
                to = far - t._sizes[lasts[back, far - 1]]
                count[back] -= ends[back, to]
                ends[back, far] = False
                ends[back, to] = True
        sure = ends.argmax(1)
        told, n_told = self._back(lasts, sure)
        out_at = len(self.out) + np.r_[0, np.cumsum(n_told)[:-1]]
        self.out.frombytes(told.astype("<u4").tobytes())
        # the states after: what isn't sure
        shift = np.minimum(np.arange(width)[None, :] + sure[:, None], width - 1)
        keep = np.arange(width)[None, :] < (size + 1 - sure)[:, None]
        before = np.where(sure > 0, lasts[rows, np.maximum(sure - 1, 0)], before)
        window = np.where(keep, np.take_along_axis(window, shift, 1), 0).astype(np.uint8)
        wide = np.zeros((many, LONG_PIECE), np.uint8)
        wide[:, :width] = window[:, :LONG_PIECE]
        to, new = np.zeros(many, np.int32), []
        for i, name in enumerate(self._name(before, size + 1 - sure, wide)):
            number = self.states.get(name)
            if number is None:
                number = self.states[name] = len(self.states)
                new.append(i)
            to[i] = number
        number = to[new]
        self.before[number], self.size[number], self.window[number] = before[new], (size + 1 - sure)[new], wide[new]
        self.lasts[number, :width] = np.where(keep, np.take_along_axis(lasts, shift, 1), 0)[new]
        self.nodes[number] = -1
        self.nodes[number, :width] = np.where(keep, np.take_along_axis(nodes, shift, 1), -1)[new]
        self._add(keys, to, out_at, n_told)
        return True

    def _back(self, lasts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens that end at a place of each row, one row's after the other, and their numbers."""
        at, rows, found = at.copy(), np.flatnonzero(at), []
        n = np.zeros(len(at), np.int64)
        while len(rows):
            token = lasts[rows, at[rows] - 1]
            found.append((rows, token))
            n[rows] += 1
            at[rows] -= self.t._sizes[token]
            rows = rows[at[rows] > 0]
        out, end = np.zeros(int(n.sum()), np.int64), np.cumsum(n)
        for k, (rows, token) in enumerate(found):
            out[end[rows] - 1 - k] = token
        return out, n

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids, as bytes, of pieces of 1 to LONG_PIECE bytes."""
        out: list[bytes] = [b""] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        many = min(MACHINE_PIECES, max(1, self.most // 16))
        for a in range(0, len(order), many):
            if len(self.states) > self.most * 3 // 4 or self.held > self.most * 3 // 2:
                self._clear()
            self._encode(pieces, order[a : a + many], out)
        return out

    def _encode(self, pieces: list[bytes], mine: list[int], out: list[bytes]) -> None:
        sizes = np.array([len(pieces[i]) for i in mine])
        width = int(sizes[0])
        data = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in mine), np.uint8).reshape(-1, width).astype(np.int64)
        state, took, lost = np.zeros(len(mine), np.int64), np.zeros((len(mine), width), np.int64), np.zeros(len(mine), bool)
        counts = np.zeros((len(mine), width + 1), np.int64)
        for place in range(width):
            many = int(np.searchsorted(-sizes, -place, side="left"))  # the longer ones come first
            keys = state[:many] * 256 + data[:many, place]
            at, missing = self._find(keys)
            if missing.any():
                new = np.unique(keys[missing & ~lost[:many]])
                if not len(new) or self._grow(new):
                    at, missing = self._find(keys)
                lost[:many] |= missing  # no room within this batch: left to simulation
            took[:many, place] = at
            counts[:many, place] = np.where(missing, 0, self.out_n[at])
            state[:many] = np.where(missing, 0, self.to[at])
        end, n_end = self._back(self.lasts[state], self.size[state].astype(np.int64))
        counts[:, width] = n_end
        # each piece's tokens: those of its transitions, then what its last state had not committed
        starts = np.concatenate([self.out_at[took], (len(self.out) + np.r_[0, np.cumsum(n_end)[:-1]])[:, None]], axis=1).ravel()
        flat = counts.ravel()
        inside = np.arange(int(flat.sum())) - np.repeat(np.cumsum(flat) - flat, flat)
        every = np.concatenate([np.frombuffer(self.out, np.uint32), end.astype(np.uint32)])
        ids = every[np.repeat(starts, flat) + inside].astype("<u4").tobytes()
        ends = (4 * np.cumsum(counts.sum(1))).tolist()
        self.read += int(sizes[~lost].sum())
        for k, (i, a, b) in enumerate(zip(mine, [0, *ends[:-1]], ends, strict=True)):
            out[i] = ids[a:b]
            if lost[k]:
                out[i] = array("I", self.t.encode(pieces[i])).tobytes()
                self.simulated += len(pieces[i])


#: Fixed value: a pattern none of whose matches goes on over a space between two characters that are no white space, or looks past one.
SPACED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Signs that are a match of SPACED_PATTERN of their own after a letter, if nothing but white space follows.
SIGNS = frozenset(".,;:!?)\"")


@cache
def _characters() -> tuple[frozenset[str], frozenset[str]]:
    """White space, and the characters on which Python and the pattern differ about what a letter is; looked for in a few thousand characters at a time."""
    white, doubtful = set(), set()
    for a in range(0, 0x110000, 4_096):
        some = "".join(map(chr, range(a, a + 4_096)))
        white.update(regex.findall(r"\s", some))
        doubtful |= set(regex.findall(r"\p{L}", some)) ^ {c for c in some if c.isalpha()}
    return frozenset(white), frozenset(doubtful)


class Encoder:
    """Texts to ids; each match of the pattern is encoded separately. Ids are little-endian unsigned 32-bit integers in bytes, as these join fast."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, share: float = 1.0) -> None:
        self.transducer = Transducer(ranks)
        self.machine: Machine | None = None
        #: What is remembered at most; a smaller share takes more time and less memory, with the same ids.
        self.most_pieces, self.most_met = (max(1, int(share * n)) for n in (MEMO_PIECES, MEMO_MET))
        self.chars = int(share * BATCH_CHARS)
        self.states = 1 << int(share * MACHINE_STATES).bit_length() - 1  # a power of two
        self.find = regex.compile(pattern).findall
        self.spaced = pattern == SPACED_PATTERN
        self.white, self.doubtful = _characters()
        #: The ids of pieces. What follows a space goes without it, so that it is found as a word of a text; all other pieces have one more space before them.
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.met: dict[str, bytes] = {}

    def _matches(self, text: str) -> list[str]:
        """The keys of a text's pieces."""
        white = self.white
        return [piece[1:] if piece[0] == " " and piece[-1] not in white else " " + piece for piece in self.find(text)]

    def _word(self, word: str) -> list[str]:
        """The keys of what follows a space, up to the next one. Letters are one piece; most other words are letters and a sign."""
        if word.isalpha() and (word.isascii() or self.doubtful.isdisjoint(word)):
            return [word]
        stem = word[:-1]
        if stem.isalpha() and word[-1] in SIGNS and (stem.isascii() or self.doubtful.isdisjoint(stem)):
            return [stem, " " + word[-1]]
        return self._matches(" " + word)

    def _grouped(self, words: list[str]) -> list[str]:
        """words joined again where white space is next to the space between them."""
        out = words[:1]
        for word in words[1:]:
            last = out[-1]
            if not word or not last or word[0] in self.white or last[-1] in self.white:
                out[-1] = f"{last} {word}"
            else:
                out.append(word)
        return out

    def _pieces(self, keys: set[str]) -> dict[str, bytes]:
        """The ids of pieces by their keys; the new ones are found together."""
        found: dict[str, bytes] = {}
        new: dict[str, bytes] = {}
        first: dict[str, bytes] = {}
        transducer, met = self.transducer, self.met
        for key in keys:
            ids = self.memo.get(key)
            if ids is None:
                ids = met.pop(key, None)
                if ids is None:
                    ids = self.older.get(key)
                if ids is not None:  # met once, or long ago: in the memo from now on
                    if len(self.memo) >= self.most_pieces:
                        self.memo, self.older = {}, self.memo
                    self.memo[key] = ids
            if ids is not None:
                found[key] = ids
                continue
            data = key[1:].encode() if key[0] == " " else b" " + key.encode()
            whole = transducer.ranks.get(data)  # a piece that is a token stays whole even if merges don't lead to it
            if whole is not None:
                first[key] = array("I", (whole,)).tobytes()
            elif 1 < len(data) <= LONG_PIECE:
                new[key] = data
            else:
                first[key] = array("I", transducer.encode(data)).tobytes()
        if new:
            if self.machine is None:
                self.machine = Machine(transducer, self.states)
            first.update(zip(new, self.machine.encode(list(new.values())), strict=True))
        # noted as met for the first time
        if len(self.met) + len(first) > self.most_met:
            self.met.clear()
        self.met.update(islice(first.items(), self.most_met))
        found.update(first)
        return found

    def encode_all(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text; words of many texts are told apart together, and their new pieces are found together."""
        out: list[bytes] = []
        part: list[str] = []
        size = 0
        for text in texts:
            part.append(text or "")
            size += len(part[-1])
            if size > self.chars:
                out += self._encode_part(part)
                part, size = [], 0
        return out + self._encode_part(part)

    def _encode_part(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if not self.spaced:
            keys = [self._matches(text) if text else [] for text in texts]
            found = self._pieces(set(chain.from_iterable(keys)))
            return [b"".join([found[key] for key in mine]) for mine in keys]
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        told = words.flatten().dictionary_encode()
        names, codes, at = told.dictionary.to_pylist(), told.indices.to_numpy(), words.offsets.to_numpy().tolist()
        white, memo = self.white, self.memo
        # the ids of each different word, or the keys of its pieces; words that are remembered have no white space at their ends
        ids: list[bytes | None] = list(map(memo.get, names))
        plain = pc.ascii_is_alpha(told.dictionary).to_pylist()
        single = {i: names[i] for i, known in enumerate(ids) if known is None and plain[i]}
        keys: dict[int, list[str]] = {}
        odd = np.zeros(len(names), bool)
        for i in [i for i, known in enumerate(ids) if known is None and not plain[i]]:
            word = names[i]
            if not word or word[0] in white or word[-1] in white:
                odd[i] = True
            else:
                keys[i] = self._word(word)
        # a text's first word follows no space, and white space next to a space is read with it
        numbers: dict[str, int] = {}
        rows: list[np.ndarray] = []
        for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
            first, row = names[codes[a]], codes[a + 1 : b]
            if b > a + 1 and (not first or first[-1] in white or odd[row].any()):
                first, *rest = self._grouped(text.split(" "))
                numbers = numbers or {name: i for i, name in enumerate(names)}
                for word in rest:
                    if (i := numbers.setdefault(word, len(ids))) == len(ids):
                        ids.append(None)
                    if ids[i] is None and i not in keys and i not in single:
                        keys[i] = self._word(word)
                row = np.array([numbers[word] for word in rest], np.int64)
            keys[len(ids)] = self._matches(first)
            rows += [np.array([len(ids)]), row]
            ids.append(None)
        found = self._pieces({*single.values(), *chain.from_iterable(keys.values())})
        for i, key in single.items():
            ids[i] = found[key]
        for i, mine in keys.items():
            ids[i] = b"".join([found[key] for key in mine])
        done = [x or b"" for x in ids]
        sizes = np.fromiter(map(len, done), np.int64, len(done)) // 4
        every, begins = np.frombuffer(b"".join(done), "<u4"), np.cumsum(sizes) - sizes
        out: list[bytes] = []
        for k in range(0, len(rows), 1_000):
            some = rows[k : k + 1_000]
            codes = np.concatenate(some)
            many = sizes[codes]
            upto = np.cumsum(many)
            data = every[np.repeat(begins[codes] - (upto - many), many) + np.arange(int(upto[-1]))].tobytes()
            cuts = [0, *(4 * upto[np.cumsum([len(a) + len(b) for a, b in zip(some[::2], some[1::2], strict=True)]) - 1]).tolist()]
            out += [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def encode_series(self, batches: Iterator[pd.Series]) -> Iterator[tuple[pd.Series, list[bytes]]]:
        """Batches of texts with their ids; as many batches go together as their characters allow."""
        held: list[pd.Series] = []
        size = 0

        def done() -> Iterator[tuple[pd.Series, list[bytes]]]:
            ids = iter(self.encode_all([text for texts in held for text in texts]))
            for texts in held:
                yield texts, list(islice(ids, len(texts)))

        for texts in batches:
            held.append(texts)
            size += sum(len(text) for text in texts if text)
            if size > self.chars:
                yield from done()
                held, size = [], 0
        yield from done()

    def forget(self) -> None:
        """Gives the pieces and the machine's tables back, as a worker may lie idle beside others."""
        self.memo, self.older, self.met, self.machine = {}, {}, {}, None

    def encode_bytes(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()


#: Bytes that may follow: state -> (lowest, highest, next state) for each kind of lead or continuation byte of well-formed UTF-8.
_UTF8 = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)],
    2: [(0x80, 0xBF, 1)],
    3: [(0x80, 0xBF, 2)],
    4: [(0xA0, 0xBF, 1)],
    5: [(0x80, 0x9F, 1)],
    6: [(0x90, 0xBF, 2)],
    7: [(0x80, 0x8F, 2)],
}
_NEXT = {s: {b: to for low, high, to in rules for b in range(low, high + 1)} for s, rules in _UTF8.items()}


class StreamingDecoder:
    """Ids in, text out as soon as its characters are complete; bytes that can't be UTF-8 become U+FFFD, one for each longest part of a character, as in Python's "replace"."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens = tokens
        self.whole = np.full(max(tokens, default=-1) + 1, None, object)  # the texts of tokens that lead from state 0 to state 0, as far as they are known
        self.known = np.zeros(len(self.whole), bool)
        self.state, self.pending = 0, b""

    def _bytes(self, data: bytes) -> str:
        out = []
        for byte in data:
            to = _NEXT[self.state].get(byte)
            if to is None:
                if self.pending:
                    out.append("�")
                self.state, self.pending = 0, b""
                to = _NEXT[0].get(byte)
                if to is None:
                    out.append("�")
                    continue
            self.pending += bytes((byte,))
            self.state = to
            if to == 0:
                out.append(self.pending.decode())
                self.pending = b""
        return "".join(out)

    def feed(self, ids: Sequence[int] | np.ndarray) -> str:
        out, at, ids = [], 0, np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.whole)):
            raise KeyError(int(ids[(ids < 0) | (ids >= len(self.whole))][0]))
        texts = self.whole[ids].tolist()
        stops = np.flatnonzero(~self.known[ids]).tolist() if len(ids) else []
        for stop in stops:
            if stop > at:
                # tokens that lead from state 0 to state 0, unless a character is open: then one by one until it is done
                while self.state and at < stop:
                    out.append(self._bytes(self.tokens[int(ids[at])]))
                    at += 1
                out += texts[at:stop]
            i = int(ids[stop])
            closed = self.state == 0
            text = self._bytes(self.tokens[i])
            if closed and self.state == 0 and "\ufffd" not in text:
                self.whole[i], self.known[i] = text, True
            out.append(text)
            at = stop + 1
        while self.state and at < len(texts):
            out.append(self._bytes(self.tokens[int(ids[at])]))
            at += 1
        out += texts[at:]
        return "".join(out)

    def finish(self) -> str:
        rest = "�" if self.pending else ""
        self.state, self.pending = 0, b""
        return rest


#: What a worker has made of vocabularies: encoders only where texts are encoded.
_KEPT = Kept()


# Functions of this module, as what tasks are sent refers to them by name: so all tasks of a worker share _KEPT.


def _encoder_of(ranks: Broadcast, key: str, pattern: str, share: float) -> Encoder:
    if share < 1:  # for little memory: it ends with its task, as idle workers take turns
        return Encoder(read_ranks(ranks.value), pattern, share)
    return _KEPT.get(("encoder", key, pattern, share), lambda: Encoder(read_ranks(ranks.value), pattern, share))


def _decoder_of(ranks: Broadcast, key: str) -> StreamingDecoder:
    return _KEPT.get(("decoder", key), lambda: StreamingDecoder({v: k for k, v in read_ranks(ranks.value).items()}))


def _done(share: float = 1.0) -> None:
    if share < 1:
        give_back()
    else:
        _KEPT.done()


class Tokenizer:
    """Column functions for a vocabulary; its file, of fixed size, is read by the driver and broadcast."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str, share: float = 1.0) -> None:
        bound_batches(spark)
        with open(ranks_path, "rb") as f:
            data = f.read()
        self.share = share
        shared, key = spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()
        self.encoder, self.decoder = partial(_encoder_of, shared, key, pattern, share), partial(_decoder_of, shared, key)

    def encode(self, text: Column) -> Column:
        """Ids of a text; none for a null or empty one."""
        own = self.encoder

        @F.pandas_udf("array<int>")
        def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoder = own()
            for _, found in encoder.encode_series(batches):
                yield pd.Series([np.frombuffer(ids, "<i4") for ids in found], dtype=object)
            _done()

        return encoded(text)

    def decode(self, ids: Column) -> Column:
        """The text of ids; empty for none or null. An id outside the vocabulary is an error."""
        own = self.decoder

        @F.pandas_udf("string")
        def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            decoder = own()
            for column in batches:
                yield pd.Series([decoder.feed(x if x is not None else ()) + decoder.finish() for x in column], dtype=object)
            _done()

        return decoded(ids)

    def digests(self, text: Column) -> Column:
        """n_tokens, ids_sha256 and decoded_sha256 of a text's ids, which don't leave the worker."""
        encoder_of, decoder_of = self.encoder, self.decoder

        @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
        def digested(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            encoder, decoder = encoder_of(), decoder_of()  # with what they remember from the worker's last task, unless that is long ago
            for _, found in encoder.encode_series(batches):
                rows = []
                for ids in found:
                    back = decoder.feed(np.frombuffer(ids, "<u4")) + decoder.finish()
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            _done()

        return digested(text)

    def checked(self, text: Column) -> Column:
        """token_ids, and round_trip: whether they decode to the text, found in the worker that encodes it."""
        encoder_of, share = self.encoder, self.share

        @F.pandas_udf("token_ids array<int>, round_trip boolean")
        def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            encoder = encoder_of()
            decoder = StreamingDecoder(encoder.transducer._bytes)
            for texts, found in encoder.encode_series(batches):
                ids = [np.frombuffer(x, "<i4") for x in found]
                same = [decoder.feed(x) + decoder.finish() == (t or "") for x, t in zip(ids, texts, strict=True)]
                yield pd.DataFrame({"token_ids": pd.Series(ids, dtype=object), "round_trip": same})
            encoder.forget()
            del encoder, decoder
            _done(share)

        return both(text)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with token_ids and n_tokens (replacing columns of these names). Null and empty texts have no tokens. Rows stay where they are: nothing is shuffled."""
    tokenizer = Tokenizer(docs.sparkSession, ranks_path, pattern)
    rest = [c for c in docs.columns if c not in ("token_ids", "n_tokens")]
    return docs.select(*rest, tokenizer.encode(F.col(text_col)).alias("token_ids")).withColumn("n_tokens", F.size("token_ids").cast("long"))


def round_trip_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", share: float = 0.25) -> DataFrame:
    """encode_documents, with round_trip: whether the ids decode to the text (null as the empty one). A worker remembers a share of what it does for encoding alone, as it stands beside what other stages have left."""
    tokenizer = Tokenizer(docs.sparkSession, ranks_path, pattern, share)
    rest = [c for c in docs.columns if c not in ("token_ids", "n_tokens", "round_trip")]
    both = docs.select(*rest, tokenizer.checked(F.col(text_col)).alias("__both"))
    return both.select(*rest, "__both.token_ids", F.size("__both.token_ids").cast("long").alias("n_tokens"), "__both.round_trip")


def decode_documents(tokens: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """tokens with decoded_text, the text of their ids."""
    tokenizer = Tokenizer(tokens.sparkSession, ranks_path, pattern)
    return tokens.withColumn("decoded_text", tokenizer.decode(F.col(ids_col)))


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the text decoded from the ids), without the ids leaving the Python workers."""
    tokenizer = Tokenizer(docs.sparkSession, ranks_path, pattern)
    return docs.select(F.col(id_col).alias("doc_id"), tokenizer.digests(F.col(text_col)).alias("d")).select("doc_id", "d.*")
