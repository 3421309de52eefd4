"""Collocations: phrases of some words whose count is high for the counts of their parts, for each language.

A task makes a row of each n-gram that can be frequent; rows are counted by (lang, phrase), joined with the counts of their parts
and with the phrases that are one word longer, and ranked. A phrase that occurs `least` times has parts that do so too. So
lengths are counted one after the other, and n-grams whose two parts of n - 1 words aren't both among the frequent ones make no
row. Tasks know the frequent ones by a table of 2^BITS bits, whatever the size of the input: a bit that is set by another phrase
lets a row through, which then isn't counted often enough. Counts are of strings, so they are exact.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import partitions, small, through_table
from barloom.llm.words import LOWER, SLICE, mixed, runs, slices, strings, word_hashes

LEAST, MAX_WORDS, TOP = 30, 4, 2000
#: A longer phrase takes the place of one within it from this share of its occurrences on, in hundredths.
SHARE = 80
#: The table of frequent phrases has 2^BITS bits (16 MB).
BITS = 27

#: 0: of a word, 1: between words, 2: between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2


def parts(text: bytes, n: int, size: int) -> list[bytes]:
    """A long text in parts that share n - 1 words, so that each n-gram is whole in exactly one of them."""
    if len(text) <= 2 * size:
        return [text]
    between = np.flatnonzero(_KIND[np.frombuffer(text, np.uint8)])
    out, start, end = [], 0, 0
    while end < len(text):
        k = np.searchsorted(between, end + size)
        end = int(between[k]) + 1 if k < len(between) else len(text)
        part = text[start:end]
        out.append(part)
        first, _ = runs(_KIND[np.frombuffer(part, np.uint8)] == 0)
        start = end if n == 1 else start + int(first[-(n - 1)]) if len(first) >= n - 1 else start
    return out


def grams(texts: list[bytes], salts: np.ndarray, n: int, known: np.ndarray | None):
    """The n-grams of texts that can be frequent: (number of the text, phrase, hash), each an array. salts: a number for the
    language of each text. known: bits of the frequent phrases of n - 1 words, None for all."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    kind = _KIND[data]
    starts, ends = runs(kind == 0)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(bounds, starts, side="right")
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    kept = kind == 0
    sizes = ends - starts
    words = mixed(word_hashes(data[kept], sizes) + salts[of])
    data[ends], kept[ends] = 0x20, True  # one space after each word
    line = data[kept]
    place = np.cumsum(sizes + 1) - sizes - 1
    at, h = np.arange(len(words)), words
    for m in range(2, n + 1):
        longer = piece[m - 1 :] == piece[: len(piece) - m + 1] if len(piece) >= m else np.zeros(0, bool)
        if m == n and known is not None:
            frequent = bits_set(known, h)
            longer = longer & frequent[: len(longer)] & frequent[1 : len(longer) + 1]
        h = mixed(h[: len(longer)] * np.uint64(3) + words[m - 1 :] * np.uint64(0xD6E8FEB86659FD95))
        at = np.flatnonzero(longer) if m == n else at[: len(longer)]
    h = h[at] if n > 1 else h
    last = at + n - 1
    return of[at], strings(line, place[at], place[last] + sizes[last]), h


def bits_set(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h >> np.uint64(64 - BITS)
    return (known[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def salts_of(langs: list[str]) -> np.ndarray:
    """A number for each language, from its name."""
    return np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)


def count_grams(docs: DataFrame, n: int, known: np.ndarray | None) -> DataFrame:
    """(lang, phrase, f) of the phrases of n words that can be frequent, over docs of lang and text."""
    shared = docs.sparkSession.sparkContext.broadcast(known.tobytes() if known is not None else None)

    def made(batches):
        bits = np.frombuffer(shared.value, np.uint8) if shared.value is not None else None
        for batch in small(batches, 1000):
            langs = batch.column("lang").dictionary_encode()
            names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            salts = salts_of(names)
            for first, texts in slices(batch.column("text").to_pylist()):
                code = codes[first : first + len(texts)]
                if any(len(t) > 2 * SLICE for t in texts):
                    cut = [(c, p) for c, t in zip(code.tolist(), texts, strict=True) for p in parts(t, n, SLICE)]
                    groups = [([p for _, p in cut[k : k + 1]], np.array([c for c, _ in cut[k : k + 1]])) for k in range(len(cut))]
                else:
                    groups = [(texts, code)]
                for some, number in groups:
                    of, phrase, _ = grams(some, salts[number], n, bits)
                    if not len(of):
                        continue
                    table = pa.table({"lang": pa.array(number[of], pa.int32()), "phrase": phrase})
                    counted = table.group_by(["lang", "phrase"], use_threads=False).aggregate([("phrase", "count")]).combine_chunks()
                    lang = pa.array(names, pa.large_string()).take(counted["lang"].chunk(0))
                    key = pc.binary_join_element_wise(lang, counted["phrase"].chunk(0).cast(pa.large_string()), pa.scalar("\n", pa.large_string())).cast(pa.string())
                    yield from pa.table([key, counted["phrase_count"].chunk(0)], names=["key", "f"]).to_batches(max_chunksize=100_000)

    rows = docs.mapInArrow(made, "key string, f long").groupBy("key").agg(F.sum("f").alias("f"))
    phrase = F.substring_index("key", "\n", -1)  # a phrase has no line break, whatever a language may have
    return rows.withColumn("phrase", phrase).select(F.left("key", F.length("key") - F.length("phrase") - 1).alias("lang"), "phrase", "f")


def bit_table(frequent: DataFrame, n: int) -> np.ndarray:
    """The 2^BITS bits of phrases of n words: of a fixed size, merged by tasks as whole numbers of 64 bits."""

    def placed(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            number = {x: k for k, x in enumerate(names)}
            _, _, h = grams([p.encode() for p in batch.column("phrase").to_pylist()], salts_of(names)[[number[x] for x in langs]] if names else np.empty(0, np.uint64), n, None)
            bit = np.unique(h >> np.uint64(64 - BITS))
            word, first = np.unique(bit >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first) if len(first) else np.empty(0, np.uint64)
            yield pa.record_batch({"word": pa.array(word.astype(np.int32)), "bits": pa.array(value.view(np.int64))})

    merged = frequent.select("lang", "phrase").mapInArrow(placed, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[merged["word"].to_numpy()] = merged["bits"].to_numpy()
    return out.view(np.uint8)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, max_words: int = MAX_WORDS, top: int = TOP, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first `top` phrases of 2 to max_words words of each language.

    Null texts are empty, a null language is `und`; an empty text or table gives no phrases, and a language without candidates no
    rows. Repeated rows count as often as they are there. Texts are read whole, once for each length; a long one is looked at in
    parts that share some words. Other columns are not read. Equal scores go by count, then by the phrase's bytes.
    """
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    levels = []
    every = through_table(count_grams(source, 1, None), "words")
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    levels.append(every.where(F.col("f") >= least))
    for n in range(2, max_words + 1):
        counted = count_grams(source, n, bit_table(levels[-1], n - 1))
        levels.append(through_table(counted.where(F.col("f") >= least), f"phrases-{n}"))
    frequent = levels[0]
    for level in levels[1:]:
        frequent = frequent.unionByName(level)
    split = frequent.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 1)

    # every cut into two parts, with both counts
    k = F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")
    cuts = split.select("lang", "phrase", F.col("f").alias("a"), "w", k)
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("rest"))
    left, right = (frequent.select("lang", F.col("phrase").alias(p), F.col("f").alias(c)) for p, c in (("head", "l"), ("rest", "r")))
    both = cuts.join(left, ["lang", "head"]).join(right, ["lang", "rest"])
    exact = "CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))"
    both = both.withColumn("score", F.expr(exact))
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    # phrases that mostly occur within one that is a word longer; what holds for one of two words more holds for one between
    longer = split.where(F.size("w") > 2)
    shorter = longer.select("lang", F.col("f").alias("by"), F.explode(F.array(F.expr("array_join(slice(w, 1, size(w) - 1), ' ')"), F.expr("array_join(slice(w, 2, size(w) - 1), ' ')"))).alias("phrase"))
    most = shorter.groupBy("lang", "phrase").agg(F.max("by").alias("by"))
    kept = best.join(most, ["lang", "phrase"], "left").where(F.col("by").isNull() | (100 * F.col("by").cast("decimal(19,0)") < share * F.col("a").cast("decimal(19,0)")))

    # a language may have most of the phrases: the first of each share of them, then the first of all
    order = [F.col("best.score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    parted = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))))
    first = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
