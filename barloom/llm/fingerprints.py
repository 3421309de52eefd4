"""Fingerprints of documents: invertible Bloom lookup sketches of their paragraphs, and likeness from what differs between two.

A paragraph is a line; a line is cut after a sentence end and after PIECE code points. The set of the paragraphs' 64-bit digests goes into
a sketch: three blocks of cells, in each of which every digest falls into one; a cell holds how many it got, and the exclusive or of
them and of their checks. Sketches of two versions are subtracted cell by cell. What both have cancels out, and peeling gets the
rest back: a cell with one digest names it, taking it away from its other cells leaves further cells with one.

The fingerprint is such a sketch with WIDTHS[0] cells in a block. Where both sets fit it, the difference of two fingerprints is peeled.
For larger sets the sketch is made larger: digests are dealt to as many sketches as needed for LOAD of them in each; of those that fail
wider ones count, of WIDTHS[1] cells in a block; if one of these failed too, the digests that differ would be counted as they are.

Rows are dealt once, to ranges of doc_id, and the first row of each range is also sent to the range before: so each meets the next
document. The cells of all sketches are sums by range, row and cell, made in one pass and without a further exchange; what else
belongs to a row goes with them as cells of its own. Peeling is done by higher-order functions on the cells of one sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import partitions

#: Code points after which a sentence is cut; cells in a block, at first and at each retry; digests in a sketch of a larger set, at most about.
PIECE, WIDTHS, LOAD = 200, (8, 128), 12
#: Ranges per shuffle partition, and bounds that are looked at together.
RANGES, STEP = 4, 32

_NONE = "array<bigint>"


def paragraphs(text: Column) -> Column:
    """The digests of a text's paragraphs, each once."""
    found = F.regexp_extract_all(text, F.lit(rf"[^\n.!?]{{1,{PIECE}}}[.!?]*|[.!?]+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(F.transform(found, lambda p: F.trim(p)), lambda p: p != ""), lambda p: F.xxhash64(p)))


def _cell(s: Column, w: Column, c: Column, k: Column, h: Column) -> Column:
    """A cell: which bits of a digest count for it and what they must be, how many it got, and what they and their checks add up to."""
    return F.struct(s.alias("s"), w.alias("w"), c.alias("c"), k.alias("k"), h.alias("h"))


def _let(value: Column, made) -> Column:
    return F.transform(F.array(value), made)[0]


def _with(cell: Column, n: Column, key: Column) -> Column:
    return _cell(cell["s"], cell["w"], cell["c"] + n, cell["k"].bitwiseXOR(key), cell["h"].bitwiseXOR(F.xxhash64(key)))


def _holds(cell: Column, key: Column, width: int) -> Column:
    return F.call_function("shiftrightunsigned", key, cell["s"]).bitwiseAND(F.lit(width - 1).cast("long")) == cell["w"]


def sketch(a: Column, width: int, b: Column | None = None) -> Column:
    """The cells that aren't empty of three blocks of `width`, for an array of digests, less those of another one."""
    empty = F.concat(*[_block(block, width) for block in range(3)])

    def filled(cell: Column) -> Column:
        done = F.aggregate(a, cell, lambda s, k: F.when(_holds(s, k, width), _with(s, F.lit(1), k)).otherwise(s))
        return done if b is None else F.aggregate(b, done, lambda s, k: F.when(_holds(s, k, width), _with(s, F.lit(-1), k)).otherwise(s))

    return F.filter(F.transform(empty, filled), _some)


def _block(block: int, width: int) -> Column:
    zero = F.lit(0).cast("long")
    return F.transform(F.sequence(zero, F.lit(width - 1).cast("long")), lambda w: _cell(F.lit(16 * block), w, zero, zero, zero))


def _some(cell: Column) -> Column:
    return (cell["c"] != 0) | (cell["k"] != 0) | (cell["h"] != 0)


def subtracted(a: Column, b: Column) -> Column:
    """The cells of one sketch less those of another, both without empty cells."""
    both = F.concat(a, F.transform(b, lambda y: _cell(y["s"], y["w"], -y["c"], y["k"], y["h"])))
    places = F.array_distinct(F.transform(both, lambda x: F.struct(x["s"].alias("s"), x["w"].alias("w"))))
    zero = F.lit(0).cast("long")

    def merged(place: Column) -> Column:
        start = _cell(place["s"], place["w"], zero, zero, zero)
        put = lambda s, x: F.when((x["s"] == s["s"]) & (x["w"] == s["w"]), _cell(s["s"], s["w"], s["c"] + x["c"], s["k"].bitwiseXOR(x["k"]), s["h"].bitwiseXOR(x["h"]))).otherwise(s)
        return F.aggregate(both, start, put)

    return F.filter(F.transform(places, merged), _some)


def _names_one(cell: Column) -> Column:
    return (F.abs(cell["c"]) == 1) & (cell["h"] == F.xxhash64(cell["k"]))


def peeled(cells: Column, width: int) -> Column:
    """(ok, gone, new) of a difference of sketches without empty cells: the digests that only the first has, and those that only the
    second has."""

    def state(cells: Column, gone: Column, new: Column) -> Column:
        """Cells that name no digest, and the digests that the others name on either side, each once."""
        named = lambda c, side: F.array_distinct(F.transform(F.filter(c, lambda x: (x["c"] == side) & (x["h"] == F.xxhash64(x["k"]))), lambda x: x["k"]))
        return _let(cells, lambda c: F.struct(F.filter(c, lambda x: ~_names_one(x)).alias("cells"), named(c, 1).alias("p"), named(c, -1).alias("m"), gone.alias("gone"), new.alias("new")))

    def step(s: Column, _) -> Column:
        def less(cell: Column) -> Column:
            done = F.aggregate(s["p"], cell, lambda x, k: F.when(_holds(x, k, width), _with(x, F.lit(-1), k)).otherwise(x))
            return F.aggregate(s["m"], done, lambda x, k: F.when(_holds(x, k, width), _with(x, F.lit(1), k)).otherwise(x))

        left = F.filter(F.transform(s["cells"], less), _some)
        return F.when((F.size(s["p"]) > 0) | (F.size(s["m"]) > 0), state(left, F.concat(s["gone"], s["p"]), F.concat(s["new"], s["m"]))).otherwise(s)

    none = F.array().cast(_NONE)
    last = F.aggregate(F.sequence(F.lit(1), F.lit(2 * width)), state(cells, none, none), step)
    return _let(last, lambda s: F.struct(((F.size(s["cells"]) == 0) & (F.size(s["p"]) == 0) & (F.size(s["m"]) == 0)).alias("ok"), s["gone"].alias("gone"), s["new"].alias("new")))


def _mask(a: str, b: str) -> Column:
    """One less than the number of sketches for two arrays of digests: a power of two, up to 2^16."""
    n = F.greatest(F.size(a) + F.size(b), F.lit(1)) / F.lit(LOAD)
    bits = F.greatest(F.least(F.ceil(F.log2(n)), F.lit(16).cast("long")), F.lit(0).cast("long"))
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")) - 1


def _part(key: Column, mask: Column) -> Column:
    return F.shiftrightunsigned(key, 48).bitwiseAND(mask)


#: What a row has: whole sketches of its text, of the edited and of the next one; the differences, dealt to several sketches; these again,
#: wider; the digests that differ, as they are; and numbers that go with it.
OWN, OTHER, AFTER, EDITED, NEXT, EDITED_WIDE, NEXT_WIDE, EDITED_ALL, NEXT_ALL, HEAD = range(10)


def with_sketches(rows: DataFrame, keys: tuple[str, str, str], head: list[Column], by: tuple[str, ...]) -> DataFrame:
    """(by, sketches, head) of rows with three arrays of digests, named by columns `by`, the first of which rows are dealt by. sketches: an
    array of (kind, part, cells without the empty ones, found, gone, new). head: whole numbers that stay with the row, as an array."""
    own, other, after = keys
    held = [*[F.col(k) for k in keys], F.array(*head)]
    sides = rows.select(*by, _mask(own, other).alias("_e"), _mask(own, after).alias("_n"), F.explode(F.array(*[F.struct(F.lit(side).alias("side"), x.alias("keys")) for side, x in enumerate(held)])).alias("x"))
    each = sides.select(*by, "_e", "_n", F.col("x.side").alias("side"), F.posexplode("x.keys").alias("j", "k"))
    narrow, wide = WIDTHS

    def place(kind: int, whose: int, n: int, block: int = 0, width: int = 1, plain: bool = False) -> Column:
        """Where a digest goes: as constants, since an expression for each place makes code too long for Java to compile."""
        named = {"kind": F.lit(kind).cast("long"), "whose": F.lit(whose), "n": F.lit(n), "shift": F.lit(16 * block), "start": F.lit(block * width).cast("long"), "mask": F.lit(width - 1).cast("long"), "plain": F.lit(plain)}
        return F.struct(*[c.alias(name) for name, c in named.items()])

    def into(kind: int, whose: int, n: int, width: int) -> list[Column]:
        return [place(kind, whose, n, block, width) for block in range(3)]

    def pair(kinds: tuple[int, int, int], whose: int, n: int) -> list[Column]:
        return [*into(kinds[0], whose, n, narrow), *into(kinds[1], whose, n, wide), place(kinds[2], 0, n, plain=True)]

    e, x = (EDITED, EDITED_WIDE, EDITED_ALL), (NEXT, NEXT_WIDE, NEXT_ALL)
    places = (
        F.when(F.col("side") == OWN, F.array(*into(OWN, 0, 1, narrow), *pair(e, 1, 1), *pair(x, 2, 1)))
        .when(F.col("side") == OTHER, F.array(*into(OTHER, 0, 1, narrow), *pair(e, 1, -1)))
        .when(F.col("side") == AFTER, F.array(*into(AFTER, 0, 1, narrow), *pair(x, 2, -1)))
        .otherwise(F.array(place(HEAD, 0, 1)))
    )
    zero = F.lit(0).cast("long")
    part = F.when(F.col("p.whose") == 1, _part(F.col("k"), F.col("_e"))).when(F.col("p.whose") == 2, _part(F.col("k"), F.col("_n"))).otherwise(zero)
    cell = F.when(F.col("p.kind") == HEAD, F.col("j").cast("long")).otherwise(F.col("p.start") + F.call_function("shiftrightunsigned", F.col("k"), F.col("p.shift")).bitwiseAND(F.col("p.mask")))
    at = F.col("p.kind") * (1 << 40) + part * (1 << 24) + cell
    put = each.select(*by, "_e", "_n", "j", "k", F.explode(places).alias("p")).select(*by, at.alias("at"), F.when(F.col("p.plain"), F.col("k")).otherwise(zero).alias("g"), F.col("p.n").alias("n"), "k", F.xxhash64("k").alias("h"))
    cells = put.groupBy(*by, "at", "g").agg(F.sum("n").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h")).where("c <> 0 OR k <> 0 OR h <> 0")
    kind, index = F.shiftright("at", 40).cast("int"), (F.col("at") % (1 << 24)).cast("int")
    width = F.when(kind.isin(EDITED_WIDE, NEXT_WIDE), wide).otherwise(narrow)
    block = F.when(kind == HEAD, 0).otherwise(F.floor(index / width)).cast("int")
    cell = _cell(block * 16, (index - block * width).cast("long"), F.col("c"), F.col("k"), F.col("h"))
    grouped = cells.withColumns({"kind": kind, "part": F.shiftright("at", 24) % (1 << 16)}).groupBy(*by, "kind", "part").agg(
        F.collect_list(F.when(~F.col("kind").isin(EDITED_ALL, NEXT_ALL), cell)).alias("cells"), F.count_if(F.col("c") > 0).alias("gone"), F.count_if(F.col("c") < 0).alias("new")
    )
    found = F.when(F.col("kind").isin(EDITED, NEXT), peeled(F.col("cells"), narrow))
    size = lambda side: F.size(F.col(f"found.{side}")).cast("long")
    counted = grouped.withColumn("found", found)
    of_found = {c: F.when(F.col("found").isNull(), F.col(c)).otherwise(size(c)) for c in ("gone", "new")}
    kept = F.when(~F.col("kind").isin(EDITED, NEXT), F.col("cells"))
    named = F.struct("kind", "part", kept.alias("cells"), F.col("found.ok").alias("ok"), of_found["gone"].alias("gone"), of_found["new"].alias("new"))
    made = counted.groupBy(*by).agg(F.collect_list(named).alias("sketches"))
    return made.withColumn("head", F.transform(F.array_sort(_cells_of(HEAD)), lambda c: c["k"]))


def _of(kind: int) -> Column:
    return F.filter("sketches", lambda x: x["kind"] == kind)


def _cells_of(kind: int) -> Column:
    return F.flatten(F.transform(_of(kind), lambda x: x["cells"]))


def with_counts(rows: DataFrame, name: str, kinds: tuple[int, int, int, int]) -> DataFrame:
    """Adds `name`, (ok, gone, new): how many digests only the text has, and how many only the other. kinds: the other's whole sketch, the
    difference in parts, these wider, and as it is. The first that peels counts: the parts (one of them is the difference of both
    fingerprints), of each part that fails the wider one; and where one of those failed too, the digests themselves."""
    _, narrow, wide, plain = kinds
    parts = f"_{name}_parts"
    sized = lambda ok, x: F.struct(ok.alias("ok"), x["gone"].alias("gone"), x["new"].alias("new"))
    counted = lambda y: F.struct(y["ok"].alias("ok"), F.size(y["gone"]).cast("long").alias("gone"), F.size(y["new"]).cast("long").alias("new"))
    wider = lambda x: _let(peeled(F.get(F.filter(_of(wide), lambda y: y["part"] == x["part"]), F.lit(0))["cells"], WIDTHS[1]), counted)
    rows = rows.withColumn(parts, F.transform(_of(narrow), lambda x: F.when(x["ok"], sized(x["ok"], x)).otherwise(wider(x))))
    total = lambda array, side: F.aggregate(array, F.lit(0).cast("long"), lambda s, x: s + x[side])
    sums = lambda array: F.struct(F.lit(True).alias("ok"), total(array, "gone").alias("gone"), total(array, "new").alias("new"))
    counts = F.when(F.forall(parts, lambda x: F.coalesce(x["ok"], F.lit(False))), sums(F.col(parts))).otherwise(sums(_of(plain)))
    return rows.withColumn(name, counts).drop(parts)


def _likeness(n: Column, found: str) -> Column:
    """What both have in common over what either has, from the first's size and the digests that differ; 1 where neither has any."""
    return F.coalesce(F.try_divide((n - F.col(f"{found}.gone")).cast("double"), (n + F.col(f"{found}.new")).cast("double")), F.lit(1.0))


def _written(cells: Column) -> Column:
    """A sketch as text, its cells in order: a byte for the place, 2 for the count, 8 for the keys, 4 for the checks."""
    number = lambda x, n: F.lpad(F.hex(x), n, "0")
    short = lambda x, bits: x.cast("long").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    place = lambda x: F.shiftright(x["s"], 4).cast("long") * WIDTHS[0] + x["w"]
    parts = F.transform(F.array_sort(cells), lambda x: F.concat(number(place(x), 2), number(short(x["c"], 16), 4), number(x["k"], 16), number(short(x["h"], 32), 8)))
    return F.replace(F.base64(F.unhex(F.array_join(parts, ""))), F.lit("\r\n"), F.lit(""))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as a string: equal for equal texts."""
    return _written(_let(paragraphs(text), lambda keys: sketch(keys, WIDTHS[0])))


def _ranges(rows: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """The least (s, h) of each range of rows: at most `ranges` pairs of numbers."""
    dealt = rows.select("s", "h").repartitionByRange(ranges, "s", "h")
    firsts = dealt.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("s", "h")).alias("least")).select("least.*")
    return sorted((r.s, r.h) for r in firsts.collect())


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", made=None) -> DataFrame:
    """(doc_id, text, next_text) and, of what made() gives by name from a text, each column and that of the next document, as next_<name>.
    _to and _turn name a row: its range, by which rows are dealt, and its turn in it.

    Documents are in order of doc_id, null ids first, those of one id by a hash of the text; after the last comes the first. Rows
    that are equal in both are in one range; other rows of one id needn't be.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumns({"s": F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")), "h": F.xxhash64("text")})
    firsts = _ranges(rows, partitions(spark) * RANGES) or [(0, 0)]
    bounds = F.array(*[F.struct(F.lit(s).cast("long").alias("s"), F.lit(h).cast("long").alias("h")) for s, h in firsts])
    coarse = F.array(*[F.struct(F.lit(s).cast("long").alias("s"), F.lit(h).cast("long").alias("h")) for s, h in firsts[::STEP]])
    reached = lambda b: (b["s"] < F.col("s")) | ((b["s"] == F.col("s")) & (b["h"] <= F.col("h")))
    rows = rows.withColumn("_from", (F.size(F.filter(coarse, reached)) - 1) * STEP)
    rows = rows.withColumn("_range", F.col("_from") + F.size(F.filter(F.slice(bounds, F.col("_from") + 1, STEP), reached)) - 1)
    first = F.element_at(bounds, F.col("_range") + 1) == F.struct("s", "h")
    to = F.when(first, F.array("_range", F.pmod(F.col("_range") - 1, F.lit(len(firsts))))).otherwise(F.array("_range"))
    sent = rows.select("doc_id", "text", "s", "h", F.posexplode(to).alias("_copy", "_to")).repartition(partitions(spark) * RANGES, "_to")
    columns = made(F.col("text")) if made else {}
    held, names = (sent.withColumns(columns) if made else sent), list(columns)
    after = Window.partitionBy("_to").orderBy("_copy", "s", "h", F.col("doc_id").isNotNull())
    placed = held.select("_to", F.row_number().over(after).alias("_turn"), "doc_id", "text", "_copy", *names, *[F.lead(c).over(after).alias(f"next_{c}") for c in ("text", *names)])
    return placed.where(F.col("_copy") == 0).drop("_copy")


def contract(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_gone, n_new) for each document.

    The edited text has its last floor(n_chars / 2) code points replaced by as many from the start of the next document's. Null texts are empty;
    texts without paragraphs are like one another. Texts are read whole, and a very long one stays in its row. Rows of one doc_id, or
    of none, are documents of their own; of equal rows each has the next as its next document. Other columns are not read.
    n_gone and n_new count the paragraphs that editing took away and brought.
    """
    rows = with_next(docs, made=lambda text: {"keys": paragraphs(text)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("_to", "_turn", "doc_id", n.cast("long").alias("n_chars"), "keys", "next_keys", edited.alias("edited"))
    rows = rows.select("_to", "_turn", "doc_id", "n_chars", "keys", "next_keys", F.sha2(F.encode("edited", "UTF-8"), 256).alias("sha"), paragraphs(F.col("edited")).alias("edited_keys"))
    digest = [F.conv(F.substring("sha", 16 * k + 1, 16), 16, -10).cast("long") for k in range(4)]
    head = [F.col("doc_id"), F.col("n_chars"), F.size("keys").cast("long"), *digest]
    made = with_sketches(rows, ("keys", "edited_keys", "next_keys"), head, ("_to", "_turn"))
    found = with_counts(with_counts(made, "_e", (OTHER, EDITED, EDITED_WIDE, EDITED_ALL)), "_n", (AFTER, NEXT, NEXT_WIDE, NEXT_ALL))
    sha = F.translate(F.concat(*[F.lpad(F.hex(F.col("head")[3 + k]), 16, "0") for k in range(4)]), "ABCDEF", "abcdef")
    size = F.col("head")[2]
    return found.select(
        F.col("head")[0].alias("doc_id"), F.col("head")[1].alias("n_chars"), sha.alias("edited_sha256"), _written(_cells_of(OWN)).alias("fingerprint"), _written(_cells_of(OTHER)).alias("edited_fingerprint"),
        _likeness(size, "_e").alias("near_edited"), _likeness(size, "_n").alias("near_next"), F.col("_e.gone").alias("n_gone"), F.col("_e.new").alias("n_new"),
    )
