"""Repeated byte strings, by interval expansion on a Burrows-Wheeler transform up to a length bound.

Spark brings strings that can be equal together. Every window of `length` bytes has an anchor: its gram of GRAM bytes with the
least hash. Equal windows have equal anchors, so

1. each block of documents lists its anchors with the range of windows that each stands for (a segment of the text);
2. anchors meet by hash, and those that occur once are forgotten: their windows have no equal;
3. blocks cut the segments of the others; a segment that a block has already cut is a repeat as it stands (so one hot passage
   sends one segment per block, however often it occurs);
4. segments meet by anchor; equal ones become one, with the first of them, and the distinct ones of anchors that have several
   are laid out in order of doc_id and place in texts of bounded size. Each text is transformed, and a breadth-first backward
   extension derives the places in the suffix order where the common prefix is 0, 1, 2 ... bytes, stopping at `length`.
   Windows between which no such place lies are equal; all but the first are repeats;
5. blocks join the repeats back to their documents.

An anchor whose segments together are longer than a text (a phrase shorter than a window, in ever differing contexts) is counted
as such in step 2. Its windows don't go to one text: blocks keep the first of each distinct one, and deal these by a 128-bit
digest of the whole window. Equal windows meet by it, at most one from each block; all but the first are repeats.

The text is dealt by block of doc_id once; that exchange serves steps 1, 3 and 5.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import block_count, blocked, pack, split_by, unpack

LENGTH = 100
GRAM = 50
#: Bytes hashed at a time, and bytes of a transformed text, about.
SLICE, TEXT = 1 << 19, 1 << 20
#: Bits of a place in a text that is sorted by packed keys.
PLACE = 21

_RANDOM = np.random.default_rng(11).integers(1, 1 << 63, 257, dtype=np.uint64)
_BASE = int(_RANDOM[256]) | 1


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram, by doubling of a polynomial hash."""
    power, size = _BASE, 1
    level = _RANDOM[data]
    out, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if gram & size:
                part = level[done : done + len(data) - gram + 1]
                out = part.copy() if out is None else out * np.uint64(power) + part
                done += size
            if 2 * size > gram:
                break
            level = level[:-size] * np.uint64(power) + level[size:]
            power, size = power * power % (1 << 64), 2 * size
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """(hash, start, windows) of each anchor of the concatenated documents that end at `ends`: it stands for the windows that
    start at start .. start + windows - 1."""
    hashes, starts, counts = [], [], []
    n = len(data)
    for s in range(0, max(n - length + 1, 0), SLICE):
        part = data[s : s + SLICE + length - 1]
        g = gram_hashes(part, gram)
        packed = g >> np.uint64(32) << np.uint64(32) | np.arange(len(g), dtype=np.uint64)
        at = (sliding_least(packed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # windows that end within the document where they start
        place = np.arange(s, s + len(at))
        limit = ends[np.searchsorted(ends, place, side="right")]
        inside = place + length <= limit
        place, at = place[inside], at[inside]
        if len(at):
            first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (place[1:] != place[:-1] + 1))))
            hashes.append(g[at[first]])
            starts.append(place[first])
            counts.append(np.diff(np.append(first, len(at))))
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(counts)


class Block:
    """The documents of a block in order of doc_id (then text; null ids first), one after the other."""

    def __init__(self, table: pa.Table):
        ids, bodies = table.column("doc_id").to_pylist(), [b or b"" for b in table.column("body").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, bodies[i]))
        self.ids = [ids[i] for i in order]
        self.bodies = [bodies[i] for i in order]
        self.data = np.frombuffer(b"".join(self.bodies), np.uint8)
        self.ends = np.cumsum([len(b) for b in self.bodies], dtype=np.int64)


def order_key(doc_id: int | None) -> int:
    return np.iinfo(np.int64).min if doc_id is None else doc_id


# -- suffix order and interval expansion ------------------------------------------------------------------------------------


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of text in order of their suffixes, by their first `depth` symbols at least; text is uint16 with 0 as separator."""
    n = len(text)
    if n >= 1 << PLACE:
        return _suffix_order_large(text, depth)
    known = 5 if int(text.max(initial=0)) < 256 else 4
    width = 8 if known == 5 else 10
    wide = np.concatenate((text.astype(np.uint64), np.zeros(known, np.uint64)))
    key = np.zeros(n, np.uint64)
    for k in range(known):
        key = key << np.uint64(width) | wide[k : k + n]
    mask = np.uint64((1 << PLACE) - 1)
    place = np.arange(n, dtype=np.uint64)
    rank = np.empty(n + 1, np.uint64)
    while True:
        ordered = np.sort(key << np.uint64(PLACE) | place)
        order = (ordered & mask).astype(np.int64)
        new = np.empty(n, bool)
        new[:1] = True
        new[1:] = ordered[1:] >> np.uint64(PLACE) != ordered[:-1] >> np.uint64(PLACE)
        rank[order] = np.cumsum(new, dtype=np.uint64)
        rank[n] = 0
        if known >= depth or new.all():
            return order
        ahead = np.zeros(n, np.uint64)
        if known < n:
            ahead[: n - known] = rank[known:n]
        key = rank[:n] << np.uint64(PLACE) | ahead
        known *= 2


def _suffix_order_large(text: np.ndarray, depth: int) -> np.ndarray:
    """The same for texts whose places and ranks don't fit one packed key."""
    n, known = len(text), 1
    rank = text.astype(np.int64)
    while True:
        ahead = np.zeros(n, np.int64)
        if known < n:
            ahead[: n - known] = rank[known:] + 1
        order = np.lexsort((ahead, rank))
        a, b = rank[order], ahead[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        known *= 2
        if known >= depth or new.all():
            return order


def expand_intervals(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each i of 0..n whether the suffixes at i - 1 and i of the order part before `length` symbols.

    Level by level, the interval of every string of that many symbols whose end is new is extended to the left by each symbol
    that precedes it (never by a separator); the end of the extended interval is a place where the common prefix has that
    many symbols.
    """
    n = len(order)
    inverse = np.empty(n, np.int32)
    inverse[order] = np.arange(n, dtype=np.int32)
    transform = text[order - 1]  # place -1 is the last separator
    back = inverse[order - 1]  # where the suffix one symbol longer stands
    counts = np.bincount(text, minlength=2)
    first = np.concatenate(([0], np.cumsum(counts)))
    forth = np.empty(n, np.int32)
    forth[back] = np.arange(n, dtype=np.int32)  # places of each symbol of the transform, in order
    # next and previous place of the same symbol
    ends = first[1:][counts > 0]
    after = np.empty(n, np.int32)
    after[forth[:-1]] = forth[1:]
    after[forth[ends - 1]] = n
    before = np.empty(n, np.int32)
    before[forth[1:]] = forth[:-1]
    before[forth[first[:-1][counts > 0]]] = -1
    symbols = np.flatnonzero(counts)
    symbols = symbols[symbols > 0]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        big = high - low > 4 * len(symbols)
        lows, highs = [], []
        if big.any():
            for c in symbols:  # ranks of the symbol at both bounds
                at = forth[first[c] : first[c + 1]]
                a, b = np.searchsorted(at, low[big]), np.searchsorted(at, high[big])
                some = b > a
                lows.append(first[c] + a[some])
                highs.append(first[c] + b[some])
        small_low, small_high = low[~big], high[~big]
        if len(small_low):
            size = small_high - small_low
            shift = np.repeat(small_low - np.concatenate(([0], np.cumsum(size)[:-1])), size)
            at = np.arange(len(shift)) + shift
            at = at[transform[at] > 0] if (transform[at] == 0).any() else at
            # the first and the last place of each symbol within its interval
            inside = np.searchsorted(small_low, at, side="right") - 1 if len(at) != len(shift) else np.repeat(np.arange(len(size)), size)
            head, tail = before[at] < small_low[inside], after[at] >= small_high[inside]
            lows.append(back[at[head]])
            highs.append(back[at[tail]] + 1)
        if not lows:
            break
        # intervals of strings of one length are disjoint, so bounds in order belong together
        low, high = np.sort(np.concatenate(lows)).astype(np.int64), np.sort(np.concatenate(highs)).astype(np.int64)
        fresh = ~known[high]
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
        known[high] = True
    return known


def repeated_windows(segments: list[bytes], counts: np.ndarray, length: int) -> np.ndarray:
    """Which windows repeat an earlier one: (segment, first window, last window + 1) of each run. Segment k has counts[k] windows."""
    sizes = np.array([len(s) for s in segments])
    raw = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    ends = np.cumsum(sizes + 1) - 1
    raw[ends] = 0
    used = np.flatnonzero(np.bincount(raw, minlength=1))  # symbols that occur, numbered from 1; separators 0
    number = np.zeros(258, np.uint16)
    number[used] = np.arange(len(used))
    text = number[raw]
    order = suffix_order(text, length)
    known = expand_intervals(text, order, length)
    starts = ends - sizes
    change = np.bincount(starts, minlength=len(text) + 1) - np.bincount(starts + counts, minlength=len(text) + 1)
    real = np.cumsum(change[:-1]) > 0
    group = np.cumsum(known[:-1])
    there = real[order]
    place, group = order[there], group[there]
    if not len(place):
        return np.empty((0, 3), np.int64)
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.repeat(np.minimum.reduceat(place, head), np.diff(np.append(head, len(place))))
    again = np.sort(place[place != least])
    if not len(again):
        return np.empty((0, 3), np.int64)
    which = np.searchsorted(ends, again)
    run = np.flatnonzero(np.concatenate(([True], (again[1:] != again[:-1] + 1) | (which[1:] != which[:-1]))))
    last = np.append(run[1:], len(again)) - 1
    k = which[run]
    return np.stack((k, again[run] - starts[k], again[last] - starts[k] + 1), 1)


# -- the steps as Spark jobs ------------------------------------------------------------------------------------------------


def mark_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): each text's bytes without those that a window of `length` bytes covers which
    also starts earlier: in a smaller doc_id, or in the same text further left.

    Null and short texts lose nothing. Rows with the same doc_id are ordered by their text; null ids come before all others, in an
    order of their own. kept is binary: a cut can fall within a character. Other columns are not read. Blocks become more with the
    input; one of 4 GiB or more (rows of one doc_id share a block) raises.
    """
    buckets = blocks = block_count(docs, text_col)
    text = blocked(docs, id_col, text_col, blocks)

    def cells(name: str, rows: list[tuple]) -> pa.Table:
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table({"bucket": pa.array(columns[0], pa.int32()), "block": pa.array(columns[1], pa.int32()), name: pa.array(columns[2], pa.binary())})

    def listed(key, table):
        block = Block(table)
        if len(block.data) >> 32:
            raise ValueError(f"a block of {len(block.data)} bytes: places in it have 32 bits")
        hashes, starts, counts = anchors(block.data, block.ends, length, gram)
        order, bounds = split_by((hashes >> np.uint64(32)) % np.uint64(buckets), buckets)
        low = hashes.astype(np.uint32)[order]
        starts, counts = starts.astype(np.uint32)[order], counts.astype(np.uint16)[order]
        rows = [(b, key[0].as_py(), pack(low[x:y], starts[x:y], counts[x:y])) for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if y > x]
        return cells("cell", rows)

    def met(key, table):
        of, parts = table.column("block").to_pylist(), [unpack(c, "u4", "u4", "u2") for c in table.column("cell").to_pylist()]
        low = np.concatenate([p[0] for p in parts])
        size = np.concatenate([p[2] for p in parts]).astype(np.int64) + length
        by_hash, fresh = np.argsort(low, kind="stable"), np.empty(len(low), bool)
        ordered = low[by_hash]
        fresh[:1], fresh[1:] = True, ordered[1:] != ordered[:-1]
        first = np.flatnonzero(fresh)
        often = np.diff(np.append(first, len(low))) > 1
        twice = ordered[first][often]
        hot = (np.add.reduceat(size[by_hash], first) if len(first) else size)[often] > TEXT
        rows = []
        for b, (h, starts, counts) in zip(of, parts, strict=True):
            at = np.searchsorted(twice, h)
            hit = twice[np.minimum(at, len(twice) - 1)] == h if len(twice) else np.zeros(len(h), bool)
            if hit.any():
                rows.append((key[0].as_py(), b, pack(h[hit], starts[hit], counts[hit], hot[at[hit]])))
        return cells("cell", rows)

    def cut(key, left, right):
        block, name = Block(left), key[0].as_py()
        if not right.num_rows:
            return cells("cell", [])
        parts = [unpack(c, "u4", "u4", "u2", "?") for c in right.column("cell").to_pylist()]
        bucket = np.repeat(np.array(right.column("bucket").to_pylist()), [len(p[0]) for p in parts])
        low, starts, counts, hot = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(starts, kind="stable")
        data, seen, new, old = block.data.tobytes(), set(), [], []
        for i, s, n in zip(order.tolist(), starts[order].tolist(), counts[order].tolist(), strict=True):
            body = data[s : s + n + length - 1]
            if body in seen:
                old.append(i)
            else:
                seen.add(body)
                new.append(i)
        at, old = np.array(new, np.int64), np.array(old, np.int64)
        ends = (starts + counts + np.uint32(length - 1)).astype(np.uint32)
        again, digests, places = hot_windows(data, starts[at[hot[at]]], counts[at[hot[at]]], length)
        at = at[~hot[at]]
        rows = []
        if len(old) or len(again):
            start, end = np.concatenate((starts[old], again)), np.concatenate((ends[old], again + np.uint32(length)))
            rows.append((name % buckets, name, b"S" + pack(start, end)))
        numbers = np.array([order_key(d) for d in block.ids], np.int64)
        id_of = lambda place: numbers[np.searchsorted(block.ends, place, side="right")] if len(numbers) else np.empty(0, np.int64)
        by, bounds = split_by(digests["high"] % np.uint64(buckets), buckets)
        digests, places = digests[by], places[by]
        for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if y > x:
                rows.append((b, name, b"W" + pack(np.ascontiguousarray(digests["high"][x:y]), np.ascontiguousarray(digests["low"][x:y]), id_of(places[x:y]), places[x:y])))
        ids = id_of(starts[at])
        by, bounds = split_by(bucket[at], buckets)
        at, ids = at[by], ids[by]
        for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if y > x:
                some = at[x:y]
                body = b"".join(data[s : s + n + length - 1] for s, n in zip(starts[some].tolist(), counts[some].tolist(), strict=True))
                rows.append((b, name, b"T" + packed_segments(low[some], ids[x:y], starts[some], counts[some], body)))
        return cells("cell", rows)

    def transformed(key, table):
        rows, parts, windows = [], [], []
        for b, c in zip(table.column("block").to_pylist(), table.column("cell").to_pylist(), strict=True):
            if c[:1] == b"S":
                rows.append((0, b, c[1:]))
            elif c[:1] == b"W":
                windows.append((b, *unpack(c[1:], "u8", "u8", "i8", "u4")))
            else:
                parts.append((b, *unpacked_segments(c[1:], length)))
        if windows:
            block = np.repeat(np.array([w[0] for w in windows]), [len(w[1]) for w in windows])
            high, low, ids, starts = (np.concatenate([w[k] for w in windows]) for k in (1, 2, 3, 4))
            order = np.lexsort((starts, block, ids, low, high))
            again = order[1:][(high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])]
            of, again = block[again], starts[again]
            for k in np.unique(of).tolist():
                start = again[of == k]
                rows.append((0, k, pack(start, start + np.uint32(length))))
        if parts:
            block = np.repeat(np.array([p[0] for p in parts]), [len(p[1]) for p in parts])
            low, ids, starts, counts = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 4))
            bodies = [s for p in parts for s in p[5]]
            found, seen, new, old = [], set(), [], []
            for i in np.lexsort((starts, block, ids)).tolist():
                if bodies[i] in seen:
                    old.append(i)
                else:
                    seen.add(bodies[i])
                    new.append(i)
            if old:
                i = np.array(old)
                found.append((block[i], starts[i].astype(np.int64), starts[i] + counts[i].astype(np.int64) + length - 1))
            by_hash = np.array(new)
            by_hash = by_hash[np.argsort(low[by_hash], kind="stable")]
            alike = low[by_hash][1:] == low[by_hash][:-1]  # windows of one segment differ, so an anchor with one distinct segment has no more repeats
            by_hash = by_hash[np.append(False, alike) | np.append(alike, False)] if len(by_hash) > 1 else by_hash[:0]
            sizes = np.cumsum(counts[by_hash].astype(np.int64) + length)
            fresh = np.flatnonzero(np.concatenate(([True], low[by_hash][1:] != low[by_hash][:-1])))
            at = 0
            while at < len(by_hash):  # whole anchors, as many as fit a text
                base = sizes[at - 1] if at else 0
                end = np.searchsorted(sizes, base + TEXT)
                k = np.searchsorted(fresh, end, side="right") - 1
                end = int(fresh[k]) if fresh[k] > at else int(fresh[k + 1]) if k + 1 < len(fresh) else len(by_hash)
                some = by_hash[at:end]
                some = some[np.lexsort((starts[some], block[some], ids[some]))]
                runs = repeated_windows([bodies[i] for i in some], counts[some].astype(np.int64), length)
                if len(runs):
                    i = some[runs[:, 0]]
                    found.append((block[i], starts[i] + runs[:, 1], starts[i] + runs[:, 2] + length - 1))
                at = end
            if found:
                b, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
                for k in np.unique(b).tolist():
                    hit = b == k
                    rows.append((0, k, pack(start[hit].astype(np.uint32), end[hit].astype(np.uint32))))
        return cells("cell", rows)

    def removed(left, right):
        block = Block(left)
        change = np.zeros(len(block.data) + 1, np.int32)
        for c in right.column("cell").to_pylist():
            start, end = unpack(c, "u4", "u4")
            np.add.at(change, start, 1)
            np.add.at(change, end, -1)
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        out, at = [], 0
        for d, body in zip(block.ids, block.bodies, strict=True):
            mask = gone[at : at + len(body)]
            n = int(np.count_nonzero(mask))
            spans = int(np.count_nonzero(mask[1:] & ~mask[:-1])) + bool(mask[:1].any()) if n else 0
            kept = block.data[at : at + len(body)][~mask].tobytes() if n else body
            out.append((d, kept, len(body), n, spans))
            at += len(body)
        types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    cell = "bucket int, block int, cell binary"
    listing = text.groupBy("block").applyInArrow(listed, cell)
    meeting = listing.groupBy("bucket").applyInArrow(met, cell)
    cutting = text.groupBy("block").cogroup(meeting.groupBy("block")).applyInArrow(cut, cell)
    spans = cutting.groupBy("bucket").applyInArrow(transformed, cell)
    return text.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(removed, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def hot_windows(data: bytes, starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's segments in order of place: the places of windows that an earlier one equals; and the digests and the places
    of the first of each distinct window."""
    n = int(counts.sum(dtype=np.int64))
    shift = np.repeat(starts.astype(np.int64) - np.concatenate(([0], np.cumsum(counts, dtype=np.int64)[:-1])) if n else starts, counts)
    places = (np.arange(n) + shift).astype(np.uint32)
    digests = np.empty(n, [("high", "<u8"), ("low", "<u8")])
    for x in range(0, n, SLICE):
        some = places[x : x + SLICE].tolist()
        digests[x : x + len(some)] = np.frombuffer(b"".join(blake2b(data[s : s + length], digest_size=16).digest() for s in some), digests.dtype)
    order = np.lexsort((places, digests["low"], digests["high"]))
    ordered = digests[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = order[new]
    return places[order[~new]], digests[first], places[first]


def packed_segments(low, ids, starts, counts, body: bytes) -> bytes:
    import zstandard

    head = pack(low, ids, starts, counts)
    return len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=1).compress(body)


def unpacked_segments(cell: bytes, length: int):
    import zstandard

    size = int.from_bytes(cell[:4], "little")
    low, ids, starts, counts = unpack(cell[4 : 4 + size], "u4", "i8", "u4", "u2")
    body = zstandard.ZstdDecompressor().decompress(cell[4 + size :])
    ends = np.cumsum(counts.astype(np.int64) + length - 1).tolist()
    return low, ids, starts, counts, [body[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


def contract(docs: DataFrame) -> DataFrame:
    done = mark_repeats(docs)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
