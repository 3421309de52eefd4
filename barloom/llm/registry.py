"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, fingerprints, jaccard, licenses, mixing, phrases, pii, quality, ranking, repeats, search, secrets, warc
from barloom.llm.common import read_table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The file of a public vocabulary: below BARLOOM_TOKENIZERS where that is set, else where the installed package has it."""
    folder = os.environ.get("BARLOOM_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), vocabulary())


def op1_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.contract(read_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.contract(read_table(spark, sf_dir, "documents"))


def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.contract(read_table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.contract(read_table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.contract(read_table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.contract(spark, sf_dir)


def op10_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(read_table(spark, sf_dir, "documents"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.contract(read_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_repeated_strings, op2_quality_rules, op3_pii_spans, op4_warc_archives, op5_secret_scan, op6_bpe_roundtrip,
             op7_source_mix, op8_exact_top_k, op9_license_scan, op10_jaccard_classes, op11_fingerprints, op12_collocations, op13_ranked_search)
    return {f.__name__: f for f in found}


OP8_SQL = """
WITH sound AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, max(CAST(list_inner_product(q.v, c.v) AS BIGINT)) AS score
  FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
  GROUP BY 1, 2
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP1_SQL = """
WITH bodies AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents
), starts AS (
  SELECT doc_id, x, unnest(range(n - 99)) AS p FROM bodies WHERE n >= 100
), windows AS (
  SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS w FROM starts
), numbered AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM windows
), later AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM numbered WHERE k > 1
), runs AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM later
), gone AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY doc_id, run
), cuts AS (
  SELECT doc_id, a, b FROM gone UNION ALL SELECT doc_id, n, n FROM bodies
), kept AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS a, a AS b FROM cuts
), joined AS (
  SELECT k.doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS rest FROM kept k JOIN bodies USING (doc_id) GROUP BY k.doc_id
), counted AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(rest)) AS kept_sha256
FROM bodies LEFT JOIN joined USING (doc_id) LEFT JOIN counted USING (doc_id)
"""

OP4_SQL = """
WITH records AS (
  SELECT page_id, url, coalesce(html, '') AS body, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), judged AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS target FROM records
)
SELECT page_id, payload_bytes, sha1(body) AS payload_digest, CASE WHEN target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN target <> page_id THEN target END AS refers_to, url
FROM judged
"""

#: Slot by slot: of the released blocks that with the earliest deadline. Weights are square roots as whole numbers of 2^-52.
OP7_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS spread FROM documents
), ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY spread, doc_id) - 1 AS k FROM docs
), sources AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS i, CAST((count(*) + 7) // 8 AS HUGEINT) AS blocks, CAST(sqrt(count(*)) * 4503599627370496 AS HUGEINT) AS r
  FROM ranked GROUP BY source
), weighted AS (
  SELECT source, i, blocks, r, CAST(sum(r) OVER () AS HUGEINT) AS p FROM sources
), bounded AS (
  SELECT *, max((blocks * p + r - 1) // r) OVER () AS most FROM weighted
), run AS (
  SELECT CAST(0 AS HUGEINT) AS slot, i, r, p, most, CAST(0 AS HUGEINT) AS j,
    first_value(i) OVER (ORDER BY (p + r - 1) // r, i) AS pick FROM bounded
  UNION ALL
  SELECT slot, i, r, p, most, j, first_value(i) OVER (ORDER BY CASE WHEN (j * p) // r <= slot THEN 0 ELSE 1 END, ((j + 1) * p + r - 1) // r, i) AS pick
  FROM (SELECT slot + 1 AS slot, i, r, p, most, CASE WHEN i = pick THEN j + 1 ELSE j END AS j FROM run WHERE slot + 1 < most)
), plan AS (
  SELECT i, j, slot, (j * p) // r AS mix_release, ((j + 1) * p + r - 1) // r AS mix_deadline FROM run WHERE i = pick
)
SELECT doc_id, s.source AS source, CAST(k // 8 AS BIGINT) AS mix_block, CAST(mix_release AS BIGINT) AS mix_release, CAST(mix_deadline AS BIGINT) AS mix_deadline,
  CAST(slot AS BIGINT) AS mix_slot, CAST(k % 8 AS INTEGER) AS mix_place
FROM ranked d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source JOIN plan ON plan.i = s.i AND plan.j = k // 8
"""

OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
), sized AS (
  SELECT doc_id, len(s) AS n, s FROM sets
), grams AS MATERIALIZED (
  SELECT doc_id, n, unnest(s) AS g FROM sized
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared, any_value(a.n) + any_value(b.n) AS total
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT u, v FROM pairs WHERE 100 * shared >= 80 * (total - shared)
), reach AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), least AS (
  SELECT u, min(v) AS v FROM reach GROUP BY u
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, least(doc_id, coalesce(v, doc_id)) AS component_id
FROM sized LEFT JOIN least ON doc_id = u
"""


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM words, (SELECT unnest([1, 2, 3, 4]) AS k)
), counted AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 30
), cuts AS (
  SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS rest
  FROM candidates, (SELECT unnest([1, 2, 3]) AS c) WHERE c < k
), scored AS (
  SELECT u.lang, u.phrase, a, c, l.f AS l, r.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score
  FROM cuts u JOIN counted l ON l.lang = u.lang AND l.phrase = u.head JOIN counted r ON r.lang = u.lang AND r.phrase = u.rest
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inner_phrases AS (
  SELECT lang, a AS by_a, unnest(list_concat([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, k - m + 2)])) AS phrase
  FROM candidates, (SELECT unnest([2, 3]) AS m) WHERE m < k
), covered AS (
  SELECT lang, phrase, max(by_a) AS by_a FROM inner_phrases GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN covered USING (lang, phrase) WHERE by_a IS NULL OR 100 * by_a < 80 * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

OP13_SQL = r"""
WITH terms AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), whole AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM terms WHERE len(t) > 0
), sized AS (
  SELECT doc_id, t, 75 + (25 * len(t) * docs) // total AS m FROM terms, whole WHERE len(t) > 0
), items AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), asked AS (
  SELECT item_id, term, count(*) AS times FROM items GROUP BY ALL
), places AS (
  SELECT doc_id, m, unnest(t) AS term FROM sized
), postings AS MATERIALIZED (
  SELECT doc_id, term, any_value(m) AS m, count(*) AS tf FROM places WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM postings, whole GROUP BY term
), scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_collocations": OP12_SQL, "op13_ranked_search": OP13_SQL, "op1_repeated_strings": OP1_SQL, "op4_warc_archives": OP4_SQL, "op7_source_mix": OP7_SQL, "op8_exact_top_k": OP8_SQL, "op10_jaccard_classes": OP10_SQL}
