import hashlib

from tokenizers import Tokenizer

from barloom.llm import bpe

PATH = "/opt/tokenizers/word_bpe_49k.json"
ODD = ["", None, "Hello wörld's 12 ab<|endoftext|>x ΣΑΣ İ", "a\x1cb\x85c d", "x" * 5000, "'ll 'S don't!!?? ½ ² é", "<|startoftext|>", "日本語テキスト 🙂🙂", "<|endoftext|", "​᠎ Aͅ"]


def test_like_the_library(spark, sf):
    lib = Tokenizer.from_file(PATH)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10**9 + i, t) for i, t in enumerate(ODD)] + [(None, "twice"), (None, "twice")]
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    want = []
    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, ids string, decoded int")
    assert bpe.digests(empty, PATH).collect() == []
    some = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, ids string, decoded int")
    assert bpe.digests(some, PATH).collect()[0].n_tokens == 2
