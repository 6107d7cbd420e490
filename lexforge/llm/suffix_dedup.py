"""Removal of repeated 50-byte strings by a common-prefix-aware distributed merge sort.

A byte is removed when a `SPAN`-byte string that covers it also starts in a document
with a smaller doc_id. Sorting the suffixes at every byte would move each byte some
fifty times, so the suffixes are thinned first without loss: in every SPAN-byte string
the `GRAM`-byte string of least hash is its anchor, equal strings have equal anchors at
equal places, and a run of strings that share an anchor is one entry. An entry is kept as
the suffix from its anchor on and, reversed, what stands before the anchor.

1. Texts are dealt to chunks by a hash of (doc_id, text), and a chunk's rows are ordered
   by these, so a text is known by its chunk and place however often a task is run again.
2. Each chunk sends the hashes of its anchors, sorted and packed by bucket, and gets a bit
   for each of them back: does it occur in another text? Entries of the others go.
3. Map: a chunk's entries are sorted into one run a bucket of anchors, and the run is
   front-coded (shared prefix length and rest).
4. Reduce: for every anchor a loser tree merges its suffixes of all runs; all trees of a
   bucket take a step together, as numpy lanes. Nodes keep the length of the prefix
   shared with the last winner, so known prefixes are never compared again. Equal
   entries coalesce to their least doc_id. The common prefix lengths that the trees
   yield, and those of the reversed part, tell which entries share a SPAN-byte string
   of n bytes before the anchor and SPAN - n after it.
5. Removed ranges, packed by chunk, meet their texts again and are united.

Rows: texts are UTF-8 bytes, null or empty ones have none. Rows that repeat a doc_id are
never compared with each other; rows without a doc_id count as the largest one. Extra
columns are ignored; an empty table gives an empty result; texts of any length are whole.
A chunk is a shuffle partition's share of the texts (see `parts_of`); rows that repeat
doc_id and text share one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import _text as tx
from ._spark import pack, parts_of, unpack

SPAN, GRAM = 50, 16
STEPS = SPAN - GRAM + 1
#: Bytes of an entry's record: the suffix, what is before it reversed, the lengths of both, and padding to whole words.
BEFORE, WIDTH = STEPS - 1, 88
WORDS = WIDTH // 8
NO_ID = np.iinfo(np.int64).max
#: Anchors are compared by the upper 48 bits of their hashes; a false match only keeps an entry longer.
ANCHOR_SHIFT = np.uint64(16)
#: Texts that are decompressed at a time.
TOGETHER = 64
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hash(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of GRAM bytes, given as two 64-bit numbers."""
    h = low * C1
    h ^= h >> np.uint64(29)
    h += high
    h *= C2
    h ^= h >> np.uint64(32)
    h *= C1
    return h


def entries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first byte, bytes, anchor offset, anchor hash) of every entry of a slice.

    An entry covers the strings that start at first .. first + bytes - SPAN.
    """
    n = len(data) - SPAN + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    m = len(data) - GRAM + 1
    low = np.ndarray(m, np.uint64, data, 0, (1,))
    high = np.ndarray(m, np.uint64, data, 8, (1,))
    h = gram_hash(low, high)
    best = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    have = 1
    while have < STEPS:  # the minimum over STEPS starts, by doubling
        add = min(have, STEPS - have)
        best = np.minimum(best[: len(best) - add], best[add:])
        have += add
    anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ok = np.ones(n + 1, bool)
    ok[n] = False
    for back in offsets[1:-1]:  # strings that would cross into the next text
        ok[max(0, back - SPAN + 1) : min(back, n)] = False
    starts = ok[:n].copy()
    starts[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[: n - 1]
    p = np.flatnonzero(starts)
    stop = np.flatnonzero(ok[:n] & (np.append(starts[1:], True) | ~ok[1:])) + 1
    at = anchor[p]
    return np.searchsorted(offsets, p, side="right") - 1, p, stop - p + SPAN - 1, at - p, tx.mix(h[at])


def _chunk(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Order of a chunk's rows, and their doc_ids in that order."""
    ids, sums = table.column("id").to_numpy(), table.column("sum").to_numpy()
    order = np.lexsort((sums, ids))
    return order, ids[order]


def _slices(table: pa.Table, order: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the first text, bytes, offsets) of the chunk's texts, in its order."""
    packed, unpress = table.column("packed").combine_chunks(), zstandard.ZstdDecompressor()
    for a in range(0, len(order), TOGETHER):
        texts = [unpress.decompress(packed[k].as_buffer()) for k in order[a : a + TOGETHER].tolist()]
        yield a, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _listed(h: np.ndarray, doc: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors by bucket and size, whether two texts of the chunk have each, and where the buckets begin."""
    order = np.lexsort((doc, h, h % np.uint64(parts)))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    several = doc[first] != doc[np.append(first[1:], len(h)) - 1] if len(h) else np.zeros(0, bool)
    h = h[first]
    return h, several, np.searchsorted(h % np.uint64(parts), np.arange(parts + 1, dtype=np.uint64))


def _chunk_anchors(table: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [(h >> ANCHOR_SHIFT, doc + a) for a, data, offsets in _slices(table, _chunk(table)[0]) for doc, _, _, _, h in [entries(data, offsets)]]
    return _listed(*(np.concatenate(x) for x in zip(*found, strict=True)), parts)


def _deal_anchors(parts: int):
    """Chunk -> its anchors, packed by bucket."""

    def run(table: pa.Table) -> pa.Table:
        h, several, edge = _chunk_anchors(table, parts)
        named = [p for p in range(parts) if edge[p] < edge[p + 1]]
        # anchors of a bucket are alike modulo parts
        blobs = [pack(np.diff(h[edge[p] : edge[p + 1]] // np.uint64(parts), prepend=np.uint64(0)), np.packbits(several[edge[p] : edge[p + 1]])) for p in named]
        return pa.table({"part": pa.array(named, pa.int32()), "chunk": pa.array([table.column("chunk")[0].as_py()] * len(named), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Bucket of anchors -> for each chunk the bits of those that another text has as well."""
    got = [unpack(b, np.uint64, np.uint8) for b in table.column("blob").to_pylist()]
    lists = [np.cumsum(g[0]) for g in got]
    size = np.array([len(x) for x in lists])
    h, several = np.concatenate(lists), np.concatenate([np.unpackbits(g[1], count=n).astype(bool) for g, n in zip(got, size.tolist(), strict=True)])
    order = np.argsort(h, kind="stable")
    again = np.zeros(len(h), bool)
    again[1:] = h[order][1:] == h[order][:-1]
    again[:-1] |= again[1:]
    several[order[again]] = True
    upto = np.cumsum(size)
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "bits": pa.array([np.packbits(several[b - n : b]).tobytes() for b, n in zip(upto, size, strict=True)], pa.binary())})


def _records(data: np.ndarray, first: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
    """An entry's record: SPAN bytes from the anchor on, those before it from right to left, and both lengths."""
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), data, np.zeros(SPAN, np.uint8)])
    window = np.lib.stride_tricks.sliding_window_view(padded, BEFORE + SPAN)[first + at]
    after = length - at
    out = np.zeros((len(first), WIDTH), np.uint8)
    out[:, :SPAN] = np.where(np.arange(SPAN) < after[:, None], window[:, BEFORE:], 0)
    out[:, SPAN : SPAN + BEFORE] = np.where(np.arange(BEFORE) < at[:, None], window[:, BEFORE - 1 :: -1], 0)
    out[:, SPAN + BEFORE], out[:, SPAN + BEFORE + 1] = after, at
    return out


def _words(records: np.ndarray) -> np.ndarray:
    """Records as big-endian words, which sort as their bytes do."""
    return np.ascontiguousarray(records).view(">u8").astype(np.uint64)


def _map_runs(parts: int):
    """A chunk and its anchors' bits -> sorted, front-coded runs of the entries that may repeat."""

    def run(table: pa.Table, bits: pa.Table) -> pa.Table:
        empty = pa.table({"part": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), "run": pa.array([], pa.binary())})
        if not table.num_rows:
            return empty
        order, ids = _chunk(table)
        h, _, edge = _chunk_anchors(table, parts)
        shared = np.zeros(len(h), bool)
        for p, b in zip(bits.column("part").to_pylist(), bits.column("bits").to_pylist(), strict=True):
            shared[edge[p] : edge[p + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=int(edge[p + 1] - edge[p]))
        known = np.sort(h[shared])
        held = []
        for a, data, offsets in _slices(table, order):
            doc, first, length, at, h = entries(data, offsets)
            some = known[np.minimum(np.searchsorted(known, h >> ANCHOR_SHIFT), len(known) - 1)] == h >> ANCHOR_SHIFT if len(known) else np.zeros(len(h), bool)
            doc, first, length, at, h = doc[some], first[some], length[some], at[some], h[some]
            if len(doc):
                held.append((((h >> ANCHOR_SHIFT) % np.uint64(parts)).astype(np.int64), doc + a, first + at - offsets[doc], _records(data, first, length, at), h))
        if not held:
            return empty
        part, doc, place, text, h = (np.concatenate(x) for x in zip(*held, strict=True))
        words = _words(text)
        sort = np.lexsort((doc, *(words[:, k] for k in range(WORDS - 1, -1, -1)), h, part))
        part, doc, place, text, words, h = part[sort], doc[sort], place[sort], text[sort], words[sort], h[sort]
        same = shared_prefix(words[1:], words[:-1])
        same = np.concatenate([[0], np.where(h[1:] == h[:-1], same, 0)])
        cut = np.searchsorted(part, np.arange(parts + 1))
        named, blobs = [p for p in range(parts) if cut[p] < cut[p + 1]], []
        for p in named:
            here = slice(cut[p], cut[p + 1])
            start = same[here].copy()
            start[0] = 0
            body = text[here][np.arange(WIDTH) >= start[:, None]]
            # the padding is left out, and so are zeros between the parts, by zstd
            mine, local = np.unique(doc[here], return_inverse=True)
            blobs.append(pack(start.astype(np.uint8), body, local.astype(np.uint32), place[here], mine.astype(np.uint32), ids[mine]))
        return pa.table({"part": pa.array(named, pa.int32()), "chunk": pa.array([table.column("chunk")[0].as_py()] * len(named), pa.int32()), "run": pa.array(blobs, pa.binary())})

    return run


def _decode(run: bytes) -> tuple[np.ndarray, ...]:
    """Records, shared prefixes, doc_ids, places in the chunk and in the text of a run's entries."""
    same, body, local, place, mine, ids = unpack(run, np.uint8, np.uint8, np.uint32, np.int64, np.uint32, np.int64)
    text = np.zeros((len(same), WIDTH), np.uint8)
    text[np.arange(WIDTH) >= same[:, None]] = body
    # a shared byte comes from the nearest earlier row that stores it
    source = np.where(np.arange(WIDTH) >= same[:, None], np.arange(len(same))[:, None], 0)
    np.maximum.accumulate(source, axis=0, out=source)
    return np.take_along_axis(text, source, axis=0), same.astype(np.int64), ids[local], mine[local].astype(np.int64), place


def shared_prefix(x: np.ndarray, y: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Equal leading bytes of rows of words; words within the `known` equal bytes are not looked at."""
    out = np.full(len(x), WIDTH, np.int64)
    todo = np.arange(len(x))
    for k in range(int(known.min()) // 8 if known is not None and len(known) else 0, WORDS):
        if not len(todo):
            break
        if known is None:
            here, wait = todo, todo[:0]
        else:
            here, wait = todo[known[todo] < 8 * k + 8], todo[known[todo] >= 8 * k + 8]
        differ = x[here, k] ^ y[here, k]
        odd = differ != 0
        if odd.any():
            d = differ[odd]
            # leading zero bytes of the difference
            zero = np.zeros(len(d), np.int64)
            for n in range(7, 0, -1):
                zero[d < (np.uint64(1) << np.uint64(8 * n))] = 8 - n
            out[here[odd]] = 8 * k + zero
        todo = np.concatenate([here[~odd], wait])
    return out


class LoserTrees:
    """Merges, for many groups at once, each group's sorted runs of records.

    A tree's node keeps the loser of its match and how long a prefix that loser shares
    with the winner that beat it. Two challengers of one past winner are compared by
    those lengths alone unless they are equal, and then only from that length on. Every
    step takes the next record of each group that has one left.
    """

    def __init__(self, words: np.ndarray, same: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """begin and end: (groups, runs, a power of two) bounds of the runs; same: prefix shared with the run's record before."""
        self.words, self.same, self.pos, self.end = words, same, begin.copy(), end
        self.groups, self.runs = begin.shape
        self.loser = np.zeros((self.groups, self.runs), np.int64)
        self.shared = np.zeros((self.groups, self.runs), np.int64)
        self.compared = 0
        # the first matches, from the leaves up
        every = np.arange(self.groups)
        run, known = np.tile(np.arange(self.runs), (self.groups, 1)), np.zeros((self.groups, self.runs), np.int64)
        width = self.runs
        while width > 1:
            width //= 2
            won, kept = np.zeros((self.groups, width), np.int64), np.zeros((self.groups, width), np.int64)
            for k in range(width):
                won[:, k], kept[:, k], self.loser[:, width + k], self.shared[:, width + k] = self._match(every, run[:, 2 * k], known[:, 2 * k], run[:, 2 * k + 1], known[:, 2 * k + 1])
            run, known = won, kept
        self.top, self.lead = run[:, 0], known[:, 0]

    def _match(self, group: np.ndarray, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, ...]:
        """(winner, its prefix with the past winner, loser, its prefix with this winner) of each group."""
        x, y = self.pos[group, a], self.pos[group, b]
        no_x, no_y = x >= self.end[group, a], y >= self.end[group, b]
        first = np.where(no_x | no_y, ~no_x, la > lb)
        with_winner = np.where(la == lb, la, np.minimum(la, lb))
        tie = np.flatnonzero(~no_x & ~no_y & (la == lb))
        if len(tie):
            u, v = self.words[x[tie]], self.words[y[tie]]
            n = shared_prefix(u, v, la[tie])
            self.compared += int((n - la[tie]).sum())
            k = np.minimum(n // 8, WORDS - 1)
            p, q = u[np.arange(len(tie)), k], v[np.arange(len(tie)), k]
            first[tie] = (p < q) | ((p == q) & (a[tie] < b[tie]))
            with_winner[tie] = n
        return np.where(first, a, b), np.where(first, la, lb), np.where(first, b, a), with_winner

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(groups, their next records, prefix shared with the group's record before)."""
        group = np.arange(self.groups)
        while True:
            run, lead = self.top[group], self.lead[group]
            some = self.pos[group, run] < self.end[group, run]
            group, run, lead = group[some], run[some], lead[some]
            if not len(group):
                return
            at = self.pos[group, run]
            yield group, at, lead
            self.pos[group, run] += 1
            more = at + 1 < self.end[group, run]
            lead = np.where(more, self.same[np.minimum(at + 1, len(self.same) - 1)], 0)
            node = (run + self.runs) // 2
            while node[0]:
                run, lead, self.loser[group, node], self.shared[group, node] = self._match(group, run, lead, self.loser[group, node], self.shared[group, node])
                node = node // 2
            self.top[group], self.lead[group] = run, lead


def merge(columns: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the concatenated entries of sorted runs: number of each one's distinct record, and of the distinct ones, in merged order, the words, the anchor's number and the prefix shared with the one before."""
    words = np.concatenate([_words(c[0]) for c in columns])
    same = np.concatenate([c[1] for c in columns])
    run = np.repeat(np.arange(len(columns)), [len(c[0]) for c in columns])
    anchor = words[:, : GRAM // 8]
    # equal records of a run are one
    new = np.ones(len(words), bool)
    new[1:] = (same[1:] < WIDTH) | (run[1:] != run[:-1])
    one = np.cumsum(new) - 1
    kept = np.flatnonzero(new)
    words, same, run, anchor = words[kept], same[kept], run[kept], anchor[kept]
    # runs of each anchor, in the order of the anchors
    cut = np.ones(len(words), bool)
    cut[1:] = (run[1:] != run[:-1]) | (anchor[1:] != anchor[:-1]).any(1)
    start = np.flatnonzero(cut)
    stop = np.append(start[1:], len(words))
    order = np.lexsort((run[start], *(anchor[start, k] for k in range(GRAM // 8))))
    start, stop = start[order], stop[order]
    head = np.ones(len(start), bool)
    head[1:] = (anchor[start[1:]] != anchor[start[:-1]]).any(1)
    group = np.cumsum(head) - 1
    many = np.bincount(group)
    first = np.cumsum(many) - many
    total = np.bincount(group, stop - start).astype(np.int64)
    slot = np.cumsum(total) - total
    # where each record goes in merged order
    goes, lead = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    width = 1
    while True:
        here = np.flatnonzero((many > width // 2) & (many <= width))
        if len(here):
            runs = np.arange(width)
            at = np.minimum(first[here][:, None] + runs, len(start) - 1)
            real = runs < many[here][:, None]
            begin, end = np.where(real, start[at], 0), np.where(real, stop[at], 0)
            done = np.zeros(len(here), np.int64)
            for g, record, shared in LoserTrees(words, same, begin, end):
                goes[record], lead[record] = slot[here[g]] + done[g], np.where(done[g] > 0, shared, 0)
                done[g] += 1
        if width >= many.max(initial=0):
            break
        width *= 2
    merged = np.empty(len(words), np.int64)
    merged[goes] = np.arange(len(words))
    lead = lead[merged]
    starts = np.zeros(len(words), bool)
    starts[slot] = True
    fresh = starts | (lead < WIDTH)
    number = np.empty(len(words), np.int64)
    number[merged] = np.cumsum(fresh) - 1
    chosen = merged[fresh]
    return number[one], words[chosen], (np.cumsum(starts) - 1)[fresh], np.where(starts, -1, lead)[fresh]


def sources(words: np.ndarray, group: np.ndarray, lead: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Least doc_id that has the SPAN-byte string with n bytes before the anchor, for each distinct record and n; NO_ID where a record has none.

    Records of an anchor agree in the SPAN - n bytes from it on where no shorter common
    prefix lies between them, and likewise in the n bytes before it.
    """
    count = len(words)
    lengths = words[:, WORDS - 1] >> np.uint64(16)  # the last word: two bytes before, both lengths, two of padding
    after, before = ((lengths >> np.uint64(8)) & np.uint64(255)).astype(np.int64), (lengths & np.uint64(255)).astype(np.int64)
    valid = (np.arange(STEPS) <= before[:, None]) & (SPAN - np.arange(STEPS) <= after[:, None])
    out = np.where(valid, least[:, None], NO_ID)
    size = np.bincount(group) if count else np.zeros(0, np.int64)
    some = np.flatnonzero(size[group] > 1)
    if not len(some):
        return out
    group, lead, least, valid = group[some], lead[some], least[some], valid[some]
    head = np.ones(len(some), bool)
    head[1:] = group[1:] != group[:-1]
    lead = np.where(head, -1, np.minimum(lead, SPAN))
    back = np.zeros((len(some), 40), np.uint8)
    back[:, :BEFORE] = np.ascontiguousarray(words[some].astype(">u8")).view(np.uint8).reshape(-1, WIDTH)[:, SPAN : SPAN + BEFORE]
    back = back.view(">u8").astype(np.uint64)
    order = np.lexsort((*(back[:, k] for k in range(4, -1, -1)), group))
    wide = np.zeros((len(some), WORDS), np.uint64)
    wide[:, :5] = back[order]
    behind = np.concatenate([[-1], np.where(group[order][1:] == group[order][:-1], np.minimum(shared_prefix(wide[1:], wide[:-1]), BEFORE), -1)])
    found = np.full(valid.shape, NO_ID)
    place = np.empty(len(some), np.int64)
    for n in range(STEPS):
        here = np.flatnonzero(valid[:, n])
        if not len(here):
            continue
        fore = np.cumsum(lead < SPAN - n)
        place[order] = np.cumsum(behind < n)
        key = fore[here] * (len(some) + 1) + place[here]
        sort = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], key[sort][1:] != key[sort][:-1]]))
        low = np.minimum.reduceat(least[here][sort], new)
        found[here[sort], n] = np.repeat(low, np.diff(np.append(new, len(here))))
    out[some] = found
    return out


def repeated(runs: list[bytes], chunks: np.ndarray) -> tuple[np.ndarray, ...]:
    """(chunk, place in the chunk, first byte, end byte) of ranges whose SPAN-byte strings start in a smaller doc_id."""
    cols = [_decode(r) for r in runs]
    number, words, group, lead = merge(cols)
    ids, doc, place = (np.concatenate([c[k] for c in cols]) for k in (2, 3, 4))
    chunk = np.repeat(chunks, [len(c[0]) for c in cols])
    least = np.full(len(words), NO_ID)
    np.minimum.at(least, number, ids)
    source = sources(words, group, lead, least)[:, ::-1]  # in the order of the strings' places
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(number), 100_000):
        b = min(a + 100_000, len(number))
        hit = np.zeros((b - a, STEPS + 2), np.int8)
        hit[:, 1:-1] = source[number[a:b]] < ids[a:b, None]
        turn = np.diff(hit, axis=1)
        r, s = np.nonzero(turn == 1)
        _, e = np.nonzero(turn == -1)
        base = place[a:b][r] - BEFORE
        out.append((chunk[a:b][r], doc[a:b][r], base + s, base + e - 1 + SPAN))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def unite(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges; ranges that touch are one."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], first[1:] > reach[:-1]])
    return first[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)]


def _reduce(table: pa.Table) -> pa.Table:
    """Bucket of runs -> the removed ranges, packed by chunk."""
    chunk, doc, a, b = repeated(table.column("run").to_pylist(), table.column("chunk").to_numpy())
    order = np.lexsort((a, doc, chunk))
    chunk, doc, a, b = (x[order] for x in (chunk, doc, a, b))
    edge = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else np.zeros(0, np.int64)
    blobs = [pack(doc[i:j].astype(np.uint32), a[i:j].astype(np.int64), (b - a)[i:j].astype(np.uint8)) for i, j in zip(edge, np.append(edge[1:], len(chunk)), strict=True)]
    return pa.table({"chunk": pa.array(chunk[edge], pa.int32()), "ranges": pa.array(blobs, pa.binary())})


def _packed(parts: int):
    """Rows -> their chunk, doc_id, hash and compressed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in tx.slices(batch.column(1)):
                ids = batch.column(0).slice(i, j - i)
                sums = tx.span_hash(tx.prefix_hash(data), offsets[:-1], offsets[1:])
                known = ids.fill_null(NO_ID)
                chunk = tx.mix(sums ^ tx.mix(known.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))) % np.uint64(parts)
                press = zstandard.ZstdCompressor(level=1)
                texts = [press.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(chunk.astype(np.int32)), ids, known, pa.array(sums.view(np.int64)), pa.array(texts, pa.binary())], names=["chunk", "doc_id", "id", "sum", "packed"])

    return run


def _cut(table: pa.Table, ranges: pa.Table) -> pa.Table:
    """A chunk and its removed ranges -> the result rows."""
    names, kinds = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    if not table.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    order, _ = _chunk(table)
    got = [unpack(r, np.uint32, np.int64, np.uint8) for r in ranges.column("ranges").to_pylist()]
    doc, first, size = (np.concatenate([np.zeros(0, np.int64), *(g[k].astype(np.int64) for g in got)]) for k in range(3))
    sort = np.argsort(doc, kind="stable")
    doc, first, size = doc[sort], first[sort], size[sort]
    edge = np.searchsorted(doc, np.arange(len(order) + 1))
    rows = []
    for at, data, offsets in _slices(table, order):
        raw = data.tobytes()
        for k, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), at):
            text, here = raw[x:y], slice(edge[k], edge[k + 1])
            if edge[k] == edge[k + 1]:
                rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), text))
                continue
            a, b = unite(first[here], first[here] + size[here])
            left = b"".join(text[u:v] for u, v in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True))
            rows.append((len(text), len(text) - len(left), len(a), hashlib.sha256(left).hexdigest(), left))
    cols = zip(*rows, strict=True)
    return pa.table([table.column("doc_id").take(pa.array(order)).combine_chunks(), *(pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True))], names=names)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row of docs(doc_id, text)."""
    parts = parts_of(docs.sparkSession)
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    # one exchange of the compressed texts, by chunk, serves all three steps
    texts = rows.mapInArrow(_packed(parts), "chunk int, doc_id long, id long, sum long, packed binary").groupBy("chunk")
    anchors = texts.applyInArrow(_deal_anchors(parts), "part int, chunk int, blob binary")
    bits = anchors.groupBy("part").applyInArrow(_shared_anchors, "chunk int, part int, bits binary")
    runs = texts.cogroup(bits.groupBy("chunk")).applyInArrow(_map_runs(parts), "part int, chunk int, run binary")
    ranges = runs.groupBy("part").applyInArrow(_reduce, "chunk int, ranges binary")
    return texts.cogroup(ranges.groupBy("chunk")).applyInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
