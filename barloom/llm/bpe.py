"""BPE encoding and decoding with a public word-end vocabulary.

Encoding: a heap of (merge rank, place) over a doubly linked list of symbols; an entry whose symbols have changed since it
was pushed is stale and skipped. Decoding: concatenation of vocabulary strings. White space never enters a symbol, so a
text is encoded chunk by chunk and each worker keeps the chunks that it has seen (bounded, and only a matter of speed).
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small

#: Words and chunks that a worker keeps before it starts anew, the longest of them, and ids that it hands on at once.
CACHE_WORDS, CACHE_LENGTH, BATCH_IDS = 1_000_000, 64, 200_000

#: Bits of an id, and of a place in a word.
WIDTH, PLACE = 17, 40

#: Fixed values of the vocabulary's format: word pattern and white space.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + WHITE + r"\p{L}\p{N}]+")
SPACES = regex.compile("[" + WHITE + "]+")
SEPARATORS = regex.compile("[\x1c-\x1f]")  # white space to str.split, but not to the vocabulary


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """One vocabulary file, loaded once per worker process."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) >> WIDTH:
            raise ValueError(f"ids of more than {WIDTH} bits: {path}")
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        # (left id, right id) as one number: rank and merged id as one number
        self.merges = {self.ids[x] << WIDTH | self.ids[y]: k << WIDTH | self.ids[x + y] for k, (x, y) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner, self.last = ([self.ids[c + end] for c in symbols] for end in ("", self.end))
        self.words: dict[str, tuple[int, ...]] = {}
        self.numbers = list(range(1 + max(*self.ids.values(), *self.special.values())))  # one object for each id, however often it is kept

    def word(self, word: str) -> list[int]:
        """Ids of one word, by merges of lowest rank first, leftmost first among equals."""
        data, inner, merges = word.encode("utf-8"), self.inner, self.merges
        n = len(data)
        ids = [inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        if n == 1:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due = [0] * n  # the entry that holds for the pair that starts here; any other is stale
        heap = []
        for i in range(n - 1):
            if (m := merges.get(ids[i] << WIDTH | ids[i + 1])) is not None:
                due[i] = e = (m >> WIDTH) << PLACE | i
                heap.append(e)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            e = pop(heap)
            i = e & (1 << PLACE) - 1
            if due[i] != e or ids[i] < 0:
                continue  # stale
            j = after[i]
            ids[i] = merges[ids[i] << WIDTH | ids[j]] & (1 << WIDTH) - 1
            ids[j] = due[i] = due[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := merges.get(ids[i] << WIDTH | ids[k])) is not None:
                    due[i] = e = (m >> WIDTH) << PLACE | i
                    push(heap, e)
            if (h := before[i]) >= 0:
                due[h] = -1
                if (m := merges.get(ids[h] << WIDTH | ids[i])) is not None:
                    due[h] = e = (m >> WIDTH) << PLACE | h
                    push(heap, e)
        return [x for x in ids if x >= 0]

    def keep(self, text: str, ids: list[int]) -> tuple[int, ...]:
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        shared = self.numbers
        found = tuple([shared[x] for x in ids])
        if len(text) <= CACHE_LENGTH:
            self.words[text] = found
        return found

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of text without white space, word by word."""
        words = [chunk] if chunk.isalpha() else WORDS.findall(chunk)
        if len(words) == 1:
            return self.keep(chunk, self.word(chunk))
        out: list[int] = []
        for word in words:
            found = self.words.get(word)
            out.extend(self.keep(word, self.word(word)) if found is None else found)
        return self.keep(chunk, out)

    def plain(self, text: str, out: list[int]) -> None:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form: characters are lowered one by one
        text = text.lower()
        words, chunk = self.words, self.chunk
        for c in SPACES.split(text) if SEPARATORS.search(text) else text.split():
            found = words.get(c)
            if found is None:
                found = chunk(c)
            out += found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if self.split_special and "<|" in text:
            for part in self.split_special.split(text):
                if part in self.special:
                    out.append(self.special[part])
                else:
                    self.plain(part, out)
        else:
            self.plain(text, out)
        return out


@lru_cache(maxsize=4)
def strings_of(path: str) -> np.ndarray:
    """Strings by id; None where there is no such id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    found = {i: x for x, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return np.array([found.get(i) for i in range(max(found) + 1)], object)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encoded_batches(batches, vocab_path: str):
    """Batches of (doc_id, ids), of BATCH_IDS ids or one text at least."""
    bpe = tokenizer(vocab_path)
    for batch in small(batches):
        at = 0
        while at < batch.num_rows:
            ids, offsets, start = [], [0], at
            while at < batch.num_rows and len(ids) < BATCH_IDS:
                ids += bpe.encode(batch.column(1)[at].as_py() or "")
                offsets.append(len(ids))
                at += 1
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, at - start), lists], names=["doc_id", "ids"])


def decoded_batch(batch: pa.RecordBatch, strings: np.ndarray) -> pa.RecordBatch:
    lists, texts = batch.column(1), []
    for cell in lists:
        ids = cell.values.drop_null().to_numpy() if cell.is_valid else np.empty(0, np.int32)
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(strings):
            ids = ids[(ids >= 0) & (ids < len(strings))]
        found = strings[ids].tolist()
        texts.append(" ".join([x for x in found if x is not None] if None in found else found))
    return pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])


def bpe_encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): token ids of every whole text.

    Null and empty texts give an empty list; repeated rows and null ids give a row each; other columns are not read.
    """
    return _texts(docs, id_col, text_col).mapInArrow(lambda batches: encoded_batches(batches, vocab_path), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, ids, decoded): vocabulary strings of the ids joined by a space, as a decoder-less tokenizer does.

    Null id lists give an empty text; ids outside the vocabulary are skipped.
    """

    def run(batches):
        strings = strings_of(vocab_path)
        for batch in small(batches):
            yield decoded_batch(batch, strings)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def bpe_roundtrip(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): bpe_encode and bpe_decode in one pass of one worker."""

    def run(batches):
        strings = strings_of(vocab_path)
        for batch in encoded_batches(batches, vocab_path):
            yield decoded_batch(batch, strings)

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Per document: n_tokens and the digests of its ids and of the decoded text."""
    return bpe_roundtrip(docs, vocab_path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
