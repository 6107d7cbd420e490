"""SentencePiece encoding and decoding as shortest paths of weighted finite-state transducers.

A model file (its path is a parameter) is compiled once a process into three transducers:

* the normaliser reads the model's rewrite rules (a double-array trie of byte strings),
  longest rule first, then maps spaces to U+2581, squeezes them and puts one in front;
* the pieces are a trie automaton: a state is a prefix of pieces, an arc reads a
  character, and a state that ends a piece writes its id;
* byte fallback: a character of no piece writes its UTF-8 bytes' ids, or <unk>.

An input is composed with these, and the path of least weight in the tropical semiring
(min, +) is the encoding:

* unigram models: a piece weighs its negated score, in 32-bit floats as the format's
  library adds them; the first of equal paths in reading order wins;
* BPE models: states remember the last piece, and going on with a piece weighs 0 if the
  merge rules leave the pair as it is, and infinity otherwise. A sequence whose pairs are
  all left as they are is the one that the merges make, so one path is finite and a
  depth-first search that takes long pieces first finds it.

Where no piece has a space after another character, a text is cut before each run of
spaces; around ASCII characters of no piece it always is. The cuts change no path, and
each distinct chunk of a slice is composed once: short chunks all together, a numpy lane
for each place that an arc leaves, and longer ones by themselves. User-defined pieces are
not rewritten; BPE models take them whole first.

Null and empty texts encode to no ids; no ids decode to the empty text. Control pieces
are never written for a text and decode to nothing. Models that keep spaces as they are
or put them behind words are refused with ValueError. Extra columns stay; a column that has
the name of the result is replaced; repeated rows give repeated results; texts of any
length are whole.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import _text as tx
from ._spark import frugal

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE_MARK = "▁"
#: Characters of the chunks that are composed together, and how many of those.
SHORT_CHUNK, TOGETHER = 48, 8000
#: Pairs of pieces whose weight a process keeps.
KEPT_PAIRS = 300_000
#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 1_000_000
#: What an unknown character costs beyond the worst piece, as the format defines.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _rules(charsmap: bytes) -> dict[bytes, bytes]:
    """Rewrite rules of a compiled map: the size of a double-array trie, the trie, and the outputs it points to."""
    size = struct.unpack_from("<I", charsmap)[0]
    units, outputs = np.frombuffer(charsmap, "<u4", size // 4, 4).tolist(), charsmap[4 + size :]
    out: dict[bytes, bytes] = {}

    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    todo = [(offset(units[0]), b"")]
    while todo:
        at, read = todo.pop()
        for byte in range(1, 256):
            unit = units[at ^ byte] if at ^ byte < len(units) else 0
            if unit & 0x800000FF != byte:
                continue
            after = (at ^ byte) ^ offset(unit)
            if unit >> 8 & 1:
                start = units[after] & 0x7FFFFFFF
                out[read + bytes([byte])] = outputs[start : outputs.index(0, start)]
            todo.append((after, read + bytes([byte])))
    return out


class Table:
    """A hash table of 64-bit keys and 32-bit values, read and written by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.count, self.bits = 0, 10
        self.key, self.value = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.put(keys.astype(np.uint64), values.astype(np.int32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not in the table."""
        self.count += len(keys)
        if not len(self.key) or 4 * self.count > len(self.key):
            held = np.flatnonzero(self.key)
            keys, values = np.concatenate([self.key[held] - np.uint64(1), keys]), np.concatenate([self.value[held], values])
            while len(self.key) < 4 * self.count or not len(self.key):
                self.bits += 1
                self.key = np.zeros(1 << self.bits, np.uint64)
            self.value = np.zeros(1 << self.bits, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            empty = self.key[at] == 0
            spot, one = np.unique(at[empty], return_index=True)
            put = todo[empty][one]
            self.key[spot], self.value[spot] = keys[put] + np.uint64(1), values[put]
            left = np.ones(len(todo), bool)
            left[np.flatnonzero(empty)[one]] = False
            todo = todo[left]
            slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is not there."""
        out, slot, want = np.full(len(keys), -1, np.int32), self._slot(keys), keys + np.uint64(1)
        held = self.key[slot]
        hit = held == want
        out[hit] = self.value[slot[hit]]
        todo = np.flatnonzero(~hit & (held != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)
            held = self.key[slot[todo]]
            hit = held == want[todo]
            out[todo[hit]] = self.value[slot[todo[hit]]]
            todo = todo[~hit & (held != 0)]
        return out


class Normaliser:
    """The rewriting transducer over bytes: at each character the longest rule, else the character itself."""

    def __init__(self, rules: dict[bytes, bytes], whole: set[bytes]):
        self.rules = rules | {w: w for w in whole}
        self.whole = sorted(whole, key=len, reverse=True)
        self.sizes = sorted({len(k) for k in rules}, reverse=True)
        #: the pairs of bytes at which a rule may begin
        self.begins = np.zeros((256, 256), bool)
        for key in self.rules:
            self.begins[key[0], key[1] if len(key) > 1 else slice(None)] = True

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.rules or not len(data):
            return data, offsets
        spots = np.flatnonzero(self.begins[data, np.append(data[1:], 0)] & (data & 0xC0 != 0x80))
        raw, ends = data.tobytes(), offsets[1:].tolist()
        owner = np.searchsorted(offsets, spots, side="right") - 1
        out, at, grown = [], 0, np.zeros(len(offsets), np.int64)
        for i, text in zip(spots.tolist(), owner.tolist(), strict=True):
            if i < at:
                continue
            end = ends[text]
            key = next((w for w in self.whole if raw.startswith(w, i, end)), None)
            if key is None:
                key = next((raw[i : i + n] for n in self.sizes if i + n <= end and raw[i : i + n] in self.rules), None)
            if key is None:
                continue
            new = self.rules[key]
            out += [raw[at:i], new]
            at = i + len(key)
            grown[text + 1] += len(new) - len(key)
        if not out:
            return data, offsets
        return np.frombuffer(b"".join([*out, raw[at:]]), np.uint8), offsets + np.cumsum(grown)


class Transducer:
    """The compiled model."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.bpe, self.unk, prefix, extra, escape, suffix, rules = False, 0, True, True, True, False, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(_fields(value))
                self.bpe, suffix = spec.get(3, 1) == 2, bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(_fields(value))
                rules = _rules(spec[2]) if spec.get(2) else {}
                prefix, extra, escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if not escape or suffix:
            raise ValueError("models that keep spaces as they are or put them behind words are not supported")
        self.prefix, self.squeeze = prefix, extra
        user = {p for p, _, kind in self.pieces if kind == USER}
        self.rewrite = Normaliser(rules, {p.encode() for p in user})
        self.whole = re.compile(b"|".join(re.escape(p.replace(SPACE_MARK, " ").encode()) for p in sorted(user, key=len, reverse=True))) if user and self.bpe else None
        self.id = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        self.score = {p: np.float32(s) for p, s, kind in self.pieces if kind == NORMAL}
        most = max(self.score.values(), default=np.float32(0))
        least = min(self.score.values(), default=np.float32(0))
        self.user = user
        self.score |= {p: np.float32(len(p.encode()) * most - np.float32(0.1)) for p in user}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unk = next((i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0)
        self.fallback = len(self.bytes) == 256
        self.longest = max(map(len, self.id), default=1)
        self.unknown_cost = np.float32(UNKNOWN_PENALTY) - least
        held = {c for p in self.id for c in p}
        self.cut = np.array([i < 128 and i != 32 and chr(i) not in held for i in range(256)])
        self.words = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.id)
        #: the piece automaton: state -> {character: next state}, and the piece a state ends
        self.arcs: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        for p in self.id:
            state = 0
            for c in p:
                step = self.arcs[state].get(c)
                if step is None:
                    step = self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.ends.append(None)
                state = step
            self.ends[state] = p
        moves = [(state << 21 | ord(c), to) for state, arcs in enumerate(self.arcs) for c, to in arcs.items()]
        self.moves = Table(np.array([k for k, _ in moves], np.uint64), np.array([v for _, v in moves], np.int32))
        self.ending = np.array([-1 if p is None else self.id[p] for p in self.ends], np.int32)
        self.weight = np.array([self.score.get(p, 0) for p, _, _ in self.pieces], np.float32)
        self.free: dict[tuple[str, str], bool] = {}
        self.pairs = Table(np.zeros(0), np.zeros(0))
        made = [self._written(i) for i in range(len(self.pieces))]
        self.size = np.array([len(b) for b in made])
        self.place = np.concatenate([[0], np.cumsum(self.size)])
        self.text = np.frombuffer(b"".join(made), np.uint8)

    def _written(self, i: int) -> bytes:
        piece, _, kind = self.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(SPACE_MARK, " ").encode()

    def _merged(self, text: str) -> list[str]:
        """What the merge rules make of a short text: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stays(self, last: str, piece: str) -> bool:
        """Do the merge rules leave `last` and `piece` side by side as they are?"""
        if len(self.free) >= KEPT_PAIRS:
            self.free.clear()
        ok = self.free[last, piece] = self._merged(last + piece) == ([last, piece] if last else [piece])
        return ok

    def shortest(self, text: str) -> list[str]:
        """Pieces of the least-weight path through the composition of one chunk with the model."""
        return self._path_by_pairs(text) if self.bpe else self._path_by_scores(text)

    def _arcs_from(self, text: str, at: int) -> list[str]:
        """Pieces that start at a place of the text, shortest first; a character of no piece stands for itself."""
        arcs, ends, out, state = self.arcs, self.ends, [], 0
        for c in text[at : at + self.longest]:
            state = arcs[state].get(c)
            if state is None:
                break
            if ends[state] is not None:
                out.append(ends[state])
        if not out or len(out[0]) > 1:
            out.insert(0, text[at])
        return out

    def _path_by_pairs(self, text: str) -> list[str]:
        """The one path of weight 0: an arc is free after a piece that it leaves as it is, and closed else."""
        if text in self.user or (text in self.id and self._stays("", text)):
            return [text]
        n, free, stays = len(text), self.free, self._stays
        path, at, open_arcs = [""], 0, [self._arcs_from(text, 0)]
        dead: set[tuple[int, str]] = set()
        while at < n:
            last, arcs = path[-1], open_arcs[-1]
            while arcs:
                piece = arcs.pop()
                ok = free.get((last, piece))
                if ok is None:
                    ok = stays(last, piece)
                if ok and (at + len(piece), piece) not in dead:
                    break
            else:
                if len(path) == 1:
                    raise AssertionError(f"no path through {text[:80]!r}")
                dead.add((at, last))
                at -= len(path.pop())
                open_arcs.pop()
                continue
            path.append(piece)
            at += len(piece)
            open_arcs.append(self._arcs_from(text, at) if at < n else [])
        return path[1:]

    def _path_by_scores(self, text: str) -> list[str]:
        """The path of least sum of negated scores."""
        n = len(text)
        gain: list[np.float32 | None] = [np.float32(0)] + [None] * n
        came = [""] * (n + 1)
        for i in range(n):
            for piece in self._arcs_from(text, i):
                score = self.score.get(piece)
                g = gain[i] + (-self.unknown_cost if score is None else score)
                j = i + len(piece)
                if gain[j] is None or g > gain[j]:
                    gain[j], came[j] = g, piece
        out, at = [], n
        while at:
            out.append(came[at])
            at -= len(came[at])
        out.reverse()
        return out

    def _name(self, piece: int) -> str:
        """A piece by its number; numbers from the vocabulary's size on are characters of no piece."""
        return self.pieces[piece][0] if piece < len(self.pieces) else chr(piece - len(self.pieces))

    def _free_pairs(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Which pairs the merge rules leave as they are; `last` is -1 at the start of a chunk."""
        keys = (last + 1).astype(np.uint64) << np.uint64(32) | piece.astype(np.uint64)
        known = self.pairs.get(keys)
        new = np.unique(keys[known < 0])
        if len(new):
            if self.pairs.count + len(new) > KEPT_PAIRS:
                self.pairs = Table(np.zeros(0), np.zeros(0))
                new = np.unique(keys)
            told = [self._merged(a + b) == ([a, b] if a else [b]) for a, b in (("" if k >> 32 == 0 else self._name((k >> 32) - 1), self._name(k & 0xFFFFFFFF)) for k in new.tolist())]
            self.pairs.put(new, np.array(told, np.int32))
            known = self.pairs.get(keys)
        return known == 1

    def shortest_all(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """shortest() of short chunks all at once: piece numbers, and how many each chunk has."""
        code = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.array([len(c) for c in chunks], np.int64)
        base = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(chunks)), size)
        depth = np.arange(len(code)) - base[owner]
        left = size[owner] - depth
        # composition: the arcs that leave each place, by length
        arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lane, state = np.arange(len(code)), np.zeros(len(code), np.int64)
        for n in range(1, self.longest + 1):
            some = left[lane] >= n
            lane, state = lane[some], state[some]
            state = self.moves.get((state << 21 | code[lane + n - 1]).astype(np.uint64))
            if n == 1:
                bare = np.ones(len(lane), bool)
                bare[state >= 0] = self.ending[state[state >= 0]] < 0
                arcs.append((lane[bare], np.ones(int(bare.sum()), np.int64), code[lane[bare]] + len(self.pieces)))
            lane, state = lane[state >= 0], state[state >= 0].astype(np.int64)
            if not len(lane):
                break
            piece = self.ending[state]
            ends = piece >= 0
            arcs.append((lane[ends], np.full(int(ends.sum()), n), piece[ends].astype(np.int64)))
        start, length, piece = (np.concatenate(x) for x in zip(*arcs, strict=True))
        rank = depth[start] * (self.longest + 1) + length
        order = np.argsort(rank.astype(np.int16) if SHORT_CHUNK * (self.longest + 2) < 32_768 else rank, kind="stable")
        start, length, piece = start[order], length[order], piece[order]
        block = np.searchsorted(depth[start], np.arange(int(size.max(initial=0)) + 1))
        # shortest paths: nodes in the order of their depth; a chunk has a node more than characters
        node = start + owner[start]
        first = base + np.arange(len(chunks))
        came, back = np.full(len(code) + len(chunks), -2, np.int64), np.zeros(len(code) + len(chunks), np.int64)
        came[first] = -1
        gain = np.full(len(came), -np.inf, np.float32)
        gain[first] = 0
        cost = np.where(piece < len(self.pieces), self.weight[np.minimum(piece, len(self.pieces) - 1)], -self.unknown_cost).astype(np.float32)
        for a, b in zip(block[:-1], block[1:], strict=True):
            x, n, p = node[a:b], length[a:b], piece[a:b]
            if self.bpe:
                ok = (came[x] > -2) & (came[x + n] == -2)
                x, n, p = x[ok], n[ok], p[ok]
                ok = self._free_pairs(came[x], p)
                came[x[ok] + n[ok]], back[x[ok] + n[ok]] = p[ok], n[ok]
            else:
                # arcs of one depth end at different nodes of a chunk
                g = gain[x] + cost[a:b]
                ok = g > gain[x + n]
                gain[x[ok] + n[ok]], came[x[ok] + n[ok]], back[x[ok] + n[ok]] = g[ok], p[ok], n[ok]
        at, lane, steps = first + size, np.arange(len(chunks)), []
        many = np.zeros(len(chunks), np.int64)
        while len(lane):
            some = at > first[lane]
            at, lane = at[some], lane[some]
            steps.append((lane, came[at]))
            many[lane] += 1
            at = at - back[at]
        upto = np.cumsum(many)
        out = np.zeros(int(many.sum()), np.int64)
        for k, (lane, found) in enumerate(steps):
            out[upto[lane] - 1 - k] = found
        if (out < 0).any():
            raise AssertionError("no path through a chunk")
        return out, many

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, and how many each has."""
        v = len(self.pieces)
        short = np.array([len(c) <= SHORT_CHUNK and c not in self.user for c in chunks], bool)
        some, size, paths = [c for c, s in zip(chunks, short.tolist(), strict=True) if s], np.zeros(len(chunks), np.int64), []
        many = []
        for k in range(0, len(some), TOGETHER):
            found, n = self.shortest_all(some[k : k + TOGETHER])
            paths.append(found.astype(np.int32))
            many.append(n)
        size[short] = np.concatenate([*many, np.zeros(0, np.int64)])
        for k in np.flatnonzero(~short).tolist():
            paths.append(np.array([self.id.get(p, v + ord(p[0])) for p in self.shortest(chunks[k])], np.int32))
            size[k] = len(paths[-1])
        flat = np.concatenate([*paths, np.zeros(0, np.int32)])
        place = np.zeros(len(chunks), np.int64)
        order = np.concatenate([np.flatnonzero(short), np.flatnonzero(~short)])
        place[order] = np.cumsum(size[order]) - size[order]
        flat, upto = _gather(flat, place, size)
        odd = np.flatnonzero(flat >= v)
        if not len(odd):
            return flat.astype(np.int32), size
        # characters of no piece: their bytes, or <unk>
        new = [[self.bytes[b] for b in chr(c - v).encode()] if self.fallback else [self.unk] for c in flat[odd].tolist()]
        width = np.ones(len(flat), np.int64)
        width[odd] = [len(x) for x in new]
        out = np.repeat(flat, width)
        goes = np.cumsum(width) - width
        out[_gather(np.arange(len(out)), goes[odd], width[odd])[0]] = [i for x in new for i in x]
        ends = np.concatenate([[0], np.cumsum(width)])[upto]
        return out.astype(np.int32), np.diff(ends)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end) for a slice."""
        docs = len(offsets) - 1
        data, offsets = self._normalised(data, offsets)
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(docs + 1, np.int64)
        space, cut = data == 32, self.cut[data]
        start = cut.copy()
        start[1:] |= cut[:-1]
        if self.words:
            start[1:] |= space[1:] & ~space[:-1]
        start[0] = True
        start[offsets[(offsets < n)]] = True
        raw = data.tobytes()
        if self.whole:
            for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for m in self.whole.finditer(raw, x, y):
                    start[m.start() + 1 : m.end()] = False
                    start[[m.start(), *([m.end()] if m.end() < n else [])]] = True
        a = np.flatnonzero(start)
        b = np.append(a[1:], n)
        _, some, which = np.unique(tx.span_hash(tx.prefix_hash(data), a, b), return_index=True, return_inverse=True)
        flat, size = self._ids([raw[x:y].decode().replace(" ", SPACE_MARK) for x, y in zip(a[some].tolist(), b[some].tolist(), strict=True)])
        ids, upto = _gather(flat, (np.cumsum(size) - size)[which], size[which])
        edge = upto[np.searchsorted(a, offsets)]
        if not self.fallback:  # unknown characters in a row are one <unk>
            again = np.zeros(len(ids), bool)
            again[1:] = (ids[1:] == self.unk) & (ids[:-1] == self.unk)
            again[edge[edge < len(ids)]] = False
            ids, edge = ids[~again], np.concatenate([[0], np.cumsum(~again)])[edge]
        return ids, edge

    def _normalised(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = self.rewrite(data, offsets)
        mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
        if len(mark):  # the mark itself stands for a space
            data = data.copy()
            data[mark] = 32
            keep = np.ones(len(data), bool)
            keep[mark + 1] = keep[mark + 2] = False
            data, offsets = data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
        if self.squeeze:  # runs of spaces become one, those at either end go
            space = data == 32
            keep = ~space
            keep[1:] |= space[1:] & ~space[:-1]
            a, b = offsets[:-1], offsets[1:]
            some = b > a
            keep[a[some]] = ~space[a[some]]
            upto = np.concatenate([[0], np.cumsum(keep)])
            data, offsets = data[keep], upto[offsets]
            last = offsets[1:][(np.diff(offsets) > 0) & (data[np.maximum(offsets[1:] - 1, 0)] == 32 if len(data) else False)] - 1
            keep = np.ones(len(data), bool)
            keep[last] = False
            upto = np.concatenate([[0], np.cumsum(keep)])
            data, offsets = data[keep], upto[offsets]
        if self.prefix:
            some = np.diff(offsets) > 0
            data = np.insert(data, offsets[:-1][some], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(some)])
        return data, offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of id sequences."""
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(self.pieces)):
            raise ValueError("an id is outside the vocabulary")
        out, upto = _gather(self.text, self.place[ids], self.size[ids])
        edge = upto[offsets]
        if self.prefix:  # the space put in front
            some = np.flatnonzero(np.diff(edge) > 0)
            lead = edge[some][out[edge[some]] == 32]
            keep = np.ones(len(out), bool)
            keep[lead] = False
            out, edge = out[keep], np.concatenate([[0], np.cumsum(keep)])[edge]
        texts = pa.Array.from_buffers(pa.large_string(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())])
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # ids that no text encodes to
            texts = pa.array([out[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.large_string())
        return texts.cast(pa.string())


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start : start + size] for every row, joined; and the rows' bounds."""
    upto = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])], upto


@lru_cache(maxsize=4)
def _compiled(model: bytes) -> Transducer:
    return Transducer(model)


def _model(path: str) -> bytes:
    """The model file's bytes: some hundred kB, read once by the driver and sent with the task."""
    with open(path, "rb") as f:
        return f.read()


def _with(schema: StructType, name: str, kind: object) -> StructType:
    return StructType([*(f for f in schema.fields if f.name != name), StructField(name, kind)])


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with a column of ids appended, and with what they decode to if a name for it is given."""
    model, schema = _model(model_path), _with(df.schema, ids, ArrayType(IntegerType(), False))
    schema = _with(schema, decoded, StringType()) if decoded else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _compiled(model)
        for batch in batches:
            names = [n for n in batch.schema.names if n not in (ids, decoded)]
            for i, j, data, offsets in tx.slices(batch.column(text), most=ENCODE_BYTES):
                flat, edge = fst.encode(data, offsets)
                new = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat, pa.int32())), *([fst.decode(flat, edge)] if decoded else [])]
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(i, j - i) for n in names), *new], names=[*names, ids, *([decoded] if decoded else [])])

    return df.mapInArrow(frugal(run), schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of a column of ids appended; null ids are none."""
    model, schema = _model(model_path), _with(df.schema, text, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _compiled(model)
        for batch in batches:
            names = [n for n in batch.schema.names if n != text]
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                lists = b.column(ids)
                size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False)
                texts = fst.decode(flat, np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), texts], names=[*names, text])

    return df.mapInArrow(frugal(run), schema)
