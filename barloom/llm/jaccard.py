"""Similarity join of word n-gram sets by signature trees.

Spark finds which documents can link at all, without loss:

1. blocks of documents send the hash of every n-gram to a bucket, once for equal sets; buckets answer with a class for each: 0
   for a gram of one document, else the logarithm of its number of documents;
2. in a document with a partner at Jaccard j, a share of j of its grams occur elsewhere; documents below that are done. The
   others list a prefix of their grams in order of class: with (1 - j) n + 1 grams, partners share one of them. Common passages
   have high classes, so prefixes hardly hold them;
3. documents whose prefixes meet form candidate groups (connected components); no link leaves a group. Large groups are split
   into nodes by size band and hash, and only nodes of equal or adjacent bands are paired: first each node alone and with the
   first of its band and of the band below; then what lies outside the largest class of the group with all nodes. A group of
   near copies of one text so costs its size, not its square;
4. each pair of nodes is joined by signature trees: hierarchical nodes with OR-combined bitmaps and size ranges, traversed
   together and pruned by the largest overlap that they allow, or where all members are connected already. What is left is
   compared exactly;
5. components of the links are the classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import block_count, blocked, pack, small, split_by, through_table, unpack
from barloom.llm.components import components
from barloom.llm.repeats import Block

WORDS, PERCENT = 5, 80
#: Members of a node that crosses the network, and of a leaf; children of an inner node; bits of a signature.
NODE, LEAF, FANOUT, BITS = 1024, 16, 8, 1024
#: Places where the members of one group meet the facts about it.
SALTS = 64
#: Bytes of text hashed at a time, and bytes of sets that a comparing group gets, about, where each is dealt once.
SLICE, GROUP_BYTES = 1 << 20, 1 << 24

_RANDOM = np.random.default_rng(23).integers(1, 1 << 63, 300, dtype=np.uint64)
_BASE = int(_RANDOM[256]) | 1
_LETTERS = _RANDOM[:256].copy()
_LETTERS[65:91] = _LETTERS[97:123]
_BREAK = np.zeros(256, bool)
_BREAK[[32, *range(9, 14)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ x >> np.uint64(32)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    size = max(SLICE + 1, n)
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64)), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        _POWERS[size] = up, down
    return _POWERS[size]


def _slice_sets(data: np.ndarray, ends: np.ndarray, words: int) -> list[np.ndarray]:
    n = len(data)
    space = _BREAK[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    # words don't run over the end of a document
    cut = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < n)]
    cut = cut[~space[cut - 1] & ~space[np.minimum(cut, n - 1)]]
    start, stop = np.unique(np.concatenate((start, cut))), np.unique(np.concatenate((stop, cut)))
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate(([np.uint64(0)], np.cumsum(_LETTERS[data] * up[:n], dtype=np.uint64)))
        word = _mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
        grams = np.zeros(max(len(word) - words + 1, 0), np.uint64)
        for k in range(words):
            grams += word[k : k + len(grams)] * _RANDOM[260 + k]
        grams = _mixed(grams)
    bounds = np.searchsorted(start, np.concatenate(([0], ends)))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                short = (word[a:b] * _RANDOM[270 : 270 + b - a]).sum(dtype=np.uint64) + _RANDOM[280 + b - a]
            out.append(_mixed(np.array([short], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def gram_sets(bodies: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct n-grams of words, A-Z lowered; a shorter text is one gram, and a text
    without words has none."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for k, body in enumerate(bodies):
        held.append(body)
        size += len(body)
        if size >= SLICE // 2 or k + 1 == len(bodies):
            out += _slice_sets(np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(b) for b in held]), words)
            held, size = [], 0
    return out


# -- signature trees --------------------------------------------------------------------------------------------------------


class Tree:
    """Nodes of a signature tree over sets, from the leaves up: (first, last + 1) of its members or children."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        self.signatures = np.zeros((len(sets), BITS // 64), np.uint64)
        for k, s in enumerate(sets):
            bits = np.zeros(BITS, bool)
            bits[s % np.uint64(BITS)] = True
            self.signatures[k] = np.packbits(bits, bitorder="little").view(np.uint64)
        weight = np.bitwise_count(self.signatures).sum(1, dtype=np.int64)
        self.levels = [(np.arange(len(sets)), np.arange(1, len(sets) + 1), self.signatures, self.sizes, self.sizes, weight)]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            low, high, bits, least, most, lightest = self.levels[-1]
            at = np.arange(0, len(low), width)
            ends = np.append(at[1:], len(low)) - 1
            self.levels.append((low[at], high[ends], np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.minimum.reduceat(lightest, at)))
            width = FANOUT

    def children(self, level: int, node: int) -> range:
        width = LEAF if level == 1 else FANOUT
        return range(node * width, min((node + 1) * width, len(self.levels[level - 1][0])))


class Groups:
    """Union-find; the least member is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def roots(self, at: np.ndarray) -> np.ndarray:
        out = self.up[at]
        while (self.up[out] != out).any():
            out = self.up[out]
        return out


def may_link(tree_a: Tree, a: int, level_a: int, tree_b: Tree, b: int, level_b: int, percent: int) -> bool:
    """Whether node a of one tree and node b of the other can hold a pair with enough overlap."""
    _, _, bits_a, least_a, most_a, light_a = (x[a] for x in tree_a.levels[level_a])
    _, _, bits_b, least_b, most_b, light_b = (x[b] for x in tree_b.levels[level_b])
    if 100 * most_a < percent * least_b or 100 * most_b < percent * least_a:
        return False
    common = int(np.bitwise_count(bits_a & bits_b).sum())
    overlap = min(most_a - max(light_a - common, 0), most_b - max(light_b - common, 0))
    return (100 + percent) * overlap >= percent * (least_a + least_b)


def link(tree_a: Tree, tree_b: Tree, groups: Groups, shift_b: int, percent: int = PERCENT) -> None:
    """Joins the members of two trees (or of one with itself) that link; members of b count from shift_b."""
    same = tree_a is tree_b
    stack = [(len(tree_a.levels) - 1, 0, len(tree_b.levels) - 1, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        if not may_link(tree_a, a, la, tree_b, b, lb, percent):
            continue
        if la <= 1 and lb <= 1:
            _leaves(tree_a, range(a, a + 1) if la == 0 else tree_a.children(1, a), tree_b, range(b, b + 1) if lb == 0 else tree_b.children(1, b), groups, shift_b, percent, same)
            continue
        rows_a = np.arange(tree_a.levels[la][0][a], tree_a.levels[la][1][a])
        rows_b = np.arange(tree_b.levels[lb][0][b], tree_b.levels[lb][1][b]) + shift_b
        if len(np.unique(groups.roots(np.concatenate((rows_a, rows_b))))) == 1:
            continue
        if la >= lb:
            for c in tree_a.children(la, a):
                if same and la == lb:  # each pair of children once
                    stack += [(la - 1, c, lb - 1, d) for d in tree_b.children(lb, b) if a != b or d >= c]
                else:
                    stack.append((la - 1, c, lb, b))
        else:
            stack += [(la, a, lb - 1, d) for d in tree_b.children(lb, b)]


def _leaves(tree_a: Tree, rows_a: range, tree_b: Tree, rows_b: range, groups: Groups, shift_b: int, percent: int, same: bool) -> None:
    sa, sb = tree_a.signatures[rows_a.start : rows_a.stop], tree_b.signatures[rows_b.start : rows_b.stop]
    na, nb = tree_a.sizes[rows_a.start : rows_a.stop], tree_b.sizes[rows_b.start : rows_b.stop]
    miss_a = np.bitwise_count(sa[:, None] & ~sb[None]).sum(2, dtype=np.int64)
    miss_b = np.bitwise_count(~sa[:, None] & sb[None]).sum(2, dtype=np.int64)
    overlap = np.minimum(na[:, None] - miss_a, nb[None] - miss_b)
    for i, j in np.argwhere((100 + percent) * overlap >= percent * (na[:, None] + nb[None])).tolist():
        x, y = rows_a.start + i, rows_b.start + j
        if same and x >= y or groups.root(x) == groups.root(y + shift_b):
            continue
        p, q = tree_a.sets[x], tree_b.sets[y]
        if len(p) > len(q):
            p, q = q, p
        both = int(np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p))
        if 100 * both >= percent * (len(p) + len(q) - both):
            groups.join(x, y + shift_b)


def linked(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Spanning links (id, least id of its class) of members among themselves, or of side 0 with side 1."""
    key = np.array([int(s[0]) for s in sets], np.uint64)  # alike sets share their least hash, and so come to the same leaf
    if side is None:
        order = np.lexsort((ids, key))
        tree = Tree([sets[i] for i in order])
        groups = Groups(len(order))
        link(tree, tree, groups, 0, percent)
    else:
        left, right = (np.flatnonzero(side == s) for s in (0, 1))
        left, right = left[np.argsort(key[left], kind="stable")], right[np.argsort(key[right], kind="stable")]
        order, groups = np.concatenate((left, right)), Groups(len(ids))
        if len(left) and len(right):
            link(Tree([sets[i] for i in left]), Tree([sets[i] for i in right]), groups, len(left), percent)
    roots = groups.roots(np.arange(len(order)))
    named = ids[order]
    least: dict[int, int] = {}
    for r, d in zip(roots.tolist(), named.tolist(), strict=True):
        least[r] = min(d, least.get(r, d))
    return [(d, least[r]) for r, d in zip(roots.tolist(), named.tolist(), strict=True) if d != least[r]]


# -- the steps as Spark jobs ------------------------------------------------------------------------------------------------


def _documents(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, first, grams, prefix): steps 1 and 2. first: the least doc_id of the block with an equal set;
    grams and prefix only where the document can have a partner elsewhere."""
    buckets = blocks = block_count(docs, text_col)
    text = blocked(docs, id_col, text_col, blocks)

    def firsts(block: Block):
        """Sets, and for each the first row with an equal one; rows without id or grams stand alone."""
        sets, seen, first = gram_sets(block.bodies, words), {}, []
        for k, s in enumerate(sets):
            first.append(seen.setdefault(s.tobytes(), k) if len(s) and block.ids[k] is not None else k)
        return sets, first

    def sent(sets, first, ids):
        """Grams of rows that speak for their set, by bucket: hash, and the bounds of the buckets in it."""
        rows = [k for k, s in enumerate(sets) if first[k] == k and len(s) and ids[k] is not None]
        if not rows:
            return rows, np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(buckets + 1, np.int64)
        row = np.repeat(np.array(rows), [len(sets[k]) for k in rows])
        grams = np.concatenate([sets[k] for k in rows])
        order, bounds = split_by(grams % np.uint64(buckets), buckets)
        return rows, row, grams, order, bounds

    def listed(key, table):
        block = Block(table)
        _, _, grams, order, bounds = sent(*firsts(block), block.ids)
        # 24 bits beside the bucket: what collides only looks more common than it is, and alike to all
        high = (grams[order] >> np.uint64(40)).astype(np.uint32)
        cells = [(b, pack(high[x:y])) for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if y > x]
        return pa.table({"bucket": pa.array([c[0] for c in cells], pa.int32()), "block": pa.array([key[0].as_py()] * len(cells), pa.int32()), "cell": pa.array([c[1] for c in cells], pa.binary())})

    def classed(key, table):
        parts = [unpack(c, "u4")[0] for c in table.column("cell").to_pylist()]
        every = np.concatenate(parts).astype(np.uint64)
        n = len(every)
        ordered = np.sort(every << np.uint64(40) | np.arange(n, dtype=np.uint64))
        high = ordered >> np.uint64(40)
        head = np.flatnonzero(np.concatenate(([True], high[1:] != high[:-1])))
        count = np.diff(np.append(head, n))
        level = np.ceil(np.log2(count)).astype(np.uint8)
        out = np.empty(n, np.uint8)
        out[(ordered & np.uint64((1 << 40) - 1)).astype(np.int64)] = np.repeat(level, count)
        ends = np.cumsum([0, *map(len, parts)])
        cells = [pack(out[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "cell": pa.array(cells, pa.binary())})

    def chosen(left, right):
        block = Block(left)
        sets, first = firsts(block)
        rows, row, grams, order, bounds = sent(sets, first, block.ids)
        level = np.zeros(len(grams), np.uint8)
        for b, c in zip(right.column("bucket").to_pylist(), right.column("cell").to_pylist(), strict=True):
            level[order[bounds[b] : bounds[b + 1]]] = unpack(c, "u1")[0]
        grams_of, prefix_of = [None] * len(sets), [None] * len(sets)
        at = 0
        for k in rows:
            s = sets[k]
            mine = level[at : at + len(s)]
            at += len(s)
            need = -(-percent * len(s) // 100)
            alone = int(np.count_nonzero(mine == 0))
            if len(s) - alone >= need:
                take = len(s) - need + 1
                ranked = s[np.lexsort((s, mine))]
                grams_of[k], prefix_of[k] = s.astype("<u8").tobytes(), ranked[alone:take].astype("<u8").tobytes()
        ids = block.ids
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()),
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "first": pa.array([ids[f] for f in first], pa.int64()),
            "grams": pa.array(grams_of, pa.binary()),
            "prefix": pa.array(prefix_of, pa.binary()),
        })

    cell = "bucket int, block int, cell binary"
    classes = text.groupBy("block").applyInArrow(listed, cell).groupBy("bucket").applyInArrow(classed, cell)
    both = text.groupBy("block").cogroup(classes.groupBy("block"))
    return both.applyInArrow(chosen, "doc_id long, n_shingles long, first long, grams binary, prefix binary")


def _candidate_edges(survivors: DataFrame) -> DataFrame:
    """(u, v): a document and the least one that shares a prefix gram with it."""
    buckets = block_count(survivors, "prefix")

    def spread(batches):
        for batch in small(batches):
            ids, prefixes = batch.column(0).to_pylist(), [np.frombuffer(p, "<u8") for p in batch.column(1).to_pylist()]
            grams = np.concatenate(prefixes) if prefixes else np.empty(0, np.uint64)
            owner = np.repeat(np.array(ids, np.int64), [len(p) for p in prefixes])
            order, bounds = split_by(grams % np.uint64(buckets), buckets)
            cells = [(b, pack(grams[order[x:y]], owner[order[x:y]])) for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.binary())], names=["bucket", "cell"])

    def met(key, table):
        parts = [unpack(c, "u8", "i8") for c in table.column("cell").to_pylist()]
        grams, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((owner, grams))
        grams, owner = grams[order], owner[order]
        head = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        least = np.repeat(owner[head], np.diff(np.append(head, len(grams))))
        pairs = np.unique(np.stack((owner, least), 1)[owner != least], axis=0)
        return pa.table({"u": pa.array(pairs[:, 0], pa.int64()), "v": pa.array(pairs[:, 1], pa.int64())})

    cells = survivors.select("doc_id", "prefix").mapInArrow(spread, "bucket int, cell binary")
    return cells.groupBy("bucket").applyInArrow(met, "u long, v long")


def _band(name: str, percent: int) -> Column:
    """Sizes of partners differ by a factor of 100 / percent at most: equal or adjacent bands."""
    return F.floor(F.log(F.col(name).cast("double")) / F.log(F.lit(100 / percent)) - 1e-9).cast("int")


def _salted(facts: DataFrame) -> DataFrame:
    """Few facts about large groups, once per salt, so that a group's members meet them in SALTS places."""
    return facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _placed(survivors: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(component, doc_id, salt, band, parts, ahead, behind): the members of candidate groups. parts: the number of nodes of the
    member's size band, null in groups of one node; ahead, behind: those of the adjacent bands."""
    members = survivors.join(groups, F.col("doc_id") == F.col("node")).select("component", "doc_id", _band("n_shingles", percent).alias("band"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    bands = members.groupBy("component", "band").agg(F.count(F.lit(1)).alias("n"))
    large = bands.groupBy("component").agg(F.sum("n").alias("size")).where(F.col("size") > NODE).select("component")
    facts = bands.join(large, "component").select("component", "band", F.ceil(F.col("n") / NODE).cast("int").alias("parts"))
    return members.join(_salted(_with_neighbours(facts, "parts")), ["component", "band", "salt"], "left")


def _with_neighbours(facts: DataFrame, name: str) -> DataFrame:
    """ahead and behind: the named number of the bands above and below, 0 where there are none."""
    ahead = facts.select("component", (F.col("band") - 1).alias("band"), F.col(name).alias("ahead"))
    behind = facts.select("component", (F.col("band") + 1).alias("band"), F.col(name).alias("behind"))
    return facts.join(ahead, ["component", "band"], "left").join(behind, ["component", "band"], "left").na.fill(0, ["ahead", "behind"])


def _turns(kind: str, side: int, count: Column, *names: Column) -> Column:
    """Pairs `names` with k for k below count, and the side on which the member takes part."""
    upto = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(upto, lambda k: F.struct(F.xxhash64(F.lit(kind), F.col("component"), *names, k).alias("pair"), F.lit(side).alias("side")))


def _first_pairs(placed: DataFrame) -> DataFrame:
    """(doc_id, pair, side): each node alone, and each with the first node of its band and of the band below."""
    band, part = F.col("band"), F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).cast("int")
    one, none = F.lit(1), F.lit(0)
    large, hub = F.col("parts").isNotNull(), F.col("part") == 0
    alone = F.struct(F.when(large, F.xxhash64(F.lit("alone"), "component", band, "part")).otherwise(F.xxhash64(F.lit("alone"), "component")).alias("pair"), F.lit(-1).alias("side"))
    sides = F.concat(
        F.array(alone),
        _turns("level", 0, F.when(hub & large, F.col("parts")).otherwise(none), band),
        F.transform(F.when(large & ~hub, F.array(one)).otherwise(F.array().cast("array<int>")), lambda _: F.struct(F.xxhash64(F.lit("level"), "component", band, "part").alias("pair"), one.alias("side"))),
        _turns("step", 0, F.when(hub & large, F.col("ahead")).otherwise(none), band + 1),
        F.transform(F.when(large & (F.col("behind") > 0), F.array(one)).otherwise(F.array().cast("array<int>")), lambda _: F.struct(F.xxhash64(F.lit("step"), "component", band, "part").alias("pair"), one.alias("side"))),
    )
    return placed.withColumn("part", part).select("doc_id", F.explode(sides).alias("s")).select("doc_id", "s.*")


def _other_pairs(large: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, pair, side): the members outside the largest class of their group, in nodes, each with every node of the same or
    an adjacent band. Two members of one class need no comparison."""
    named = large.join(classes, F.col("doc_id") == F.col("node_"), "left").select(*large.columns, F.coalesce("class_", "doc_id").alias("class"))
    tally = named.groupBy("component", "class").agg(F.count(F.lit(1)).alias("n"))
    largest = tally.groupBy("component").agg(F.max(F.struct("n", "class"))["class"].alias("class"))
    rest = named.join(_salted(largest), ["component", "class", "salt"], "left_anti")
    few = rest.groupBy("component", "band").agg(F.ceil(F.count(F.lit(1)) / NODE).cast("int").alias("few"))
    facts = _salted(few).select("component", "band", "salt", "few")
    part, band = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.col("band")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("few")).cast("int")

    def named_pairs(side: int, k: Column, upto: Column, other: Column, flip: bool) -> Column:
        # a pair is (band and part of the rest, band and part of all)
        upto = F.when(upto > 0, F.sequence(F.lit(0), upto - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(upto, lambda j: F.struct((F.xxhash64(F.lit("rest"), "component", other, j, band, k) if flip else F.xxhash64(F.lit("rest"), "component", band, k, other, j)).alias("pair"), F.lit(side).alias("side")))

    ours = rest.join(facts, ["component", "band", "salt"]).withColumn("k", mine)
    left = ours.select("doc_id", F.explode(F.concat(*[named_pairs(0, F.col("k"), F.col(n), band + d, False) for d, n in ((-1, "behind"), (0, "parts"), (1, "ahead"))])).alias("s"))
    # the bands next to a band of the rest meet it too
    around = few.select("component", F.explode(F.array(*[F.struct((band + d).alias("band"), F.when(F.lit(d == -1), F.col("few")).otherwise(0).alias("over"), F.when(F.lit(d == 0), F.col("few")).otherwise(0).alias("same"), F.when(F.lit(d == 1), F.col("few")).otherwise(0).alias("under")) for d in (-1, 0, 1)])).alias("f"))
    around = around.select("component", "f.*").groupBy("component", "band").agg(*[F.max(n).alias(n) for n in ("over", "same", "under")])
    all_of = large.select("component", "doc_id", "band", "salt", part.alias("k")).join(_salted(around), ["component", "band", "salt"])
    right = all_of.select("doc_id", F.explode(F.concat(*[named_pairs(1, F.col("k"), F.col(n), band + d, True) for d, n in ((1, "over"), (0, "same"), (-1, "under"))])).alias("s"))
    return left.unionByName(right).select("doc_id", "s.*")


def _linked(dealt: DataFrame, survivors: DataFrame, percent: int) -> DataFrame:
    """(u, v): exact links that span the classes of each pair of nodes."""
    tasks = block_count(survivors, "grams", GROUP_BYTES)
    rows = dealt.join(survivors.select("doc_id", "grams"), "doc_id").withColumn("task", F.pmod(F.xxhash64("pair"), F.lit(tasks)).cast("int"))

    def joined(key, table):
        ids, side = np.array(table.column("doc_id").to_pylist(), np.int64), np.array(table.column("side").to_pylist())
        pair, grams = np.array(table.column("pair").to_pylist(), np.int64), table.column("grams").to_pylist()
        out: list[tuple[int, int]] = []
        order = np.argsort(pair, kind="stable")
        head = np.flatnonzero(np.concatenate(([True], pair[order][1:] != pair[order][:-1])))
        for x, y in zip(head, np.append(head[1:], len(order)), strict=True):
            some = order[x:y]
            sets = [np.frombuffer(grams[i], "<u8") for i in some]
            out += linked(ids[some], sets, None if side[some[0]] < 0 else side[some], percent)
        return pa.table({"u": pa.array([o[0] for o in out], pa.int64()), "v": pa.array([o[1] for o in out], pa.int64())})

    return rows.select("task", "doc_id", "pair", "side", "grams").groupBy("task").applyInArrow(joined, "u long, v long")


def _links(survivors: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(u, v): steps 3 and 4. What the nodes and the first node of each band connect needs no further pairs."""
    placed = through_table(_placed(survivors, groups, percent), "members")
    first = through_table(_linked(_first_pairs(placed), survivors, percent), "links")
    large = placed.where("parts IS NOT NULL")
    if large.isEmpty():
        return first
    of_large = first.join(large.select(F.col("doc_id").alias("u")).distinct(), "u", "left_semi")
    classes = components(of_large).select(F.col("node").alias("node_"), F.col("component").alias("class_"))
    return first.unionByName(_linked(_other_pairs(large, classes), survivors, percent))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): the class of each document under links at Jaccard >= percent / 100.

    Null texts and texts without words have no grams and stand alone. Rows with a null id stand alone with a null component. Rows
    with the same doc_id are one node: links of any of them count for all. Other columns are not read.
    """
    table = through_table(_documents(docs, id_col, text_col, words, percent), "gram-sets")
    survivors = table.where("grams IS NOT NULL").select("doc_id", "n_shingles", "grams", "prefix")
    groups = components(_candidate_edges(survivors))
    same = table.where("first <> doc_id").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    classes = components(_links(survivors, groups, percent).unionByName(same))
    rows = table.select("doc_id", "n_shingles")
    joined = rows.join(classes, rows["doc_id"] == classes["node"], "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
