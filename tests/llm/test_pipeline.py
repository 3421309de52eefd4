import hashlib

from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import mixing, pii, quality
from barloom.llm import spans as S
from tests.llm.test_bpe import PATH
from tests.llm.test_jaccard import brute as classes
from tests.llm.test_quality import brute as counts


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    # quality: the base rule by brute force, the learned rules as they are
    kept = {r.doc_id for r in quality.quality_rules(docs, labels).collect() if r.kept}
    assert kept <= {d for d, r in rows.items() if not counts(r.text)[-1]}
    first = corpus_pipeline.quality_stage(spark, docs, sf)
    assert first.columns == docs.columns and {tuple(r) for r in first.collect()} == {tuple(rows[d]) for d in kept}
    # near duplicates
    stay = {d for d, _, c in classes([(d, rows[d].text) for d in kept]) if d == c}
    second = corpus_pipeline.near_duplicate_stage(spark, first, sf)
    assert second.columns == docs.columns and {tuple(r) for r in second.collect()} == {tuple(rows[d]) for d in stay}
    # personal data
    model, masked = pii.trained(), {}
    for d in stay:
        t = rows[d].text
        base = S.personal(t)
        masked[d] = pii.redact(t, base + pii.added(t, model, base))
        assert not S.personal(masked[d])
    third = corpus_pipeline.personal_data_stage(spark, second, sf)
    assert {(r.doc_id, r.text, r.n_chars) for r in third.collect()} == {(d, t, len(t)) for d, t in masked.items()}
    # mixing: every document, in the order of slots
    order = sorted(mixing.mix(third).collect(), key=lambda r: (r.mix_slot, r.mix_place))
    fourth = corpus_pipeline.mixing_stage(spark, third, sf)
    assert fourth.columns == docs.columns and [r.doc_id for r in fourth.collect()] == [r.doc_id for r in order]
    # tokens, and the whole
    lib, want = Tokenizer.from_file(PATH), {}
    for d, t in masked.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        want[d] = (ids, len(ids), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.ids, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_empty_and_odd_documents(spark, sf, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    fine = " ".join(f"word{i}" for i in range(40))
    other, third = (" ".join(f"{w}{i}" for i in range(40)) for w in ("other", "third"))
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, fine, "en", "a", 1), (3, fine, "en", "a", 1), (4, fine, "en", None, 1), (None, fine + " x", "en", "b", 1)]
    odd += [(3, other, "en", "a", 1), (None, third, "en", "b", 1), (None, third, None, None, None)]  # one id or none, and nothing in common
    for rows, want in ((odd, [3, 3, None]), ([], [])):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert sorted((r.doc_id for r in docs.collect()), key=str) == sorted(want, key=str)
