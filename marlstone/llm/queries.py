"""Thin queries over whole tables: each calls an operator and derives its digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import read
from marlstone.llm.decontaminate import contaminated_spans
from marlstone.llm.filter_audit import audit_corpus
from marlstone.llm.hard_negatives import hard_negatives, scaled
from marlstone.llm.html_extract import extract_text
from marlstone.llm.license_scan import scan_licenses
from marlstone.llm.near_dedup import near_duplicates
from marlstone.llm.order_minhash import fingerprint_edits
from marlstone.llm.packing import packed_pieces, tokenizer_path
from marlstone.llm.substring_dedup import substring_dedup
from marlstone.llm.token_output import packed_sequences
from marlstone.llm.topk_hamming import sign_codes, top_k
from marlstone.llm.toxicity import score_toxicity
from marlstone.llm.url_filter import filter_urls

SIZE = 2048


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).drop("notices")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(read(spark, sf_dir, "documents"), tokenizer_path(), size=SIZE)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read(spark, sf_dir, "documents"))
    # Texts that nothing was cut from still have their own white space.
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated_spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a sequence: what it holds, and checksums of its row of ids and of positions."""
    out = packed_sequences(read(spark, sf_dir, "documents"), tokenizer_path(), size=SIZE)
    crc = lambda c: F.crc32(c).alias(f"{c}_crc32")
    return out.select("doc_ids", "pieces", "starts", "cu_seqlens", "n_tokens", crc("ids"), crc("positions"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages")).drop("score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other rows of every row whose vec_id 20 divides, by the sign bits of the embedding."""
    codes = sign_codes(read(spark, sf_dir, "embeddings"))
    return top_k(codes, codes.where("id % 20 = 0"), k=10)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_corpus(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(scaled(vectors))


#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
FOLDED = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = r"""
WITH w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i, len(l) AS n
           FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents)),
g AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS t FROM w),
h AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS first_doc FROM g WHERE i <= n - 12),
d AS (SELECT w.doc_id, w.i, w.word,
             coalesce(max(CASE WHEN h.first_doc < h.doc_id THEN h.i END) OVER (PARTITION BY w.doc_id ORDER BY w.i) >= w.i - 12, false) AS gone
      FROM w LEFT JOIN h ON h.doc_id = w.doc_id AND h.i = w.i),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
             string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM d GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN s USING (doc_id)
"""

OP5_SQL = rf"""
WITH d AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {FOLDED.format("text")} AS l FROM documents)),
b AS (SELECT item_id, l, len(l) AS n FROM (SELECT item_id, {FOLDED.format("text")} AS l FROM benchmark) WHERE len(l) > 0),
p AS (SELECT DISTINCT item_id, least(10, n) AS k, array_to_string(list_slice(l, j, j + least(10, n) - 1), ' ') AS t
      FROM (SELECT item_id, l, n, unnest(range(1, greatest(2, n - 8))) AS j FROM b)),
g AS (SELECT doc_id, i, k, string_agg(word, ' ') OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN CURRENT ROW AND k - 1 FOLLOWING) AS t,
             count(*) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN CURRENT ROW AND k - 1 FOLLOWING) AS have
      FROM d, (SELECT DISTINCT k FROM p)),
m AS (SELECT g.doc_id, g.i, g.k, p.item_id FROM g JOIN p ON p.k = g.k AND p.t = g.t WHERE have = g.k),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_words FROM d GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: coalesce(x > 0, false)::INT) AS c FROM embeddings WHERE len(embedding) > 0),
d AS (SELECT q.vec_id AS query_id, x.vec_id AS id, list_sum(list_transform(list_zip(q.c, x.c), lambda z: (z[1] <> z[2])::INT))::INT AS distance
      FROM v q, v x WHERE q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id AND len(q.c) = len(x.c)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM d)
SELECT query_id, rank, id, distance FROM r WHERE rank <= 10
"""

OP11_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
m AS (SELECT t, min(doc_id) AS first_id FROM w GROUP BY t),
y AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, (len(l) < 200)::INT AS A, (100 * len(list_distinct(l)) < 50 * len(l))::INT AS B,
             (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT AS C, regexp_matches(t, '[#$%&*|]')::INT AS D,
             coalesce(doc_id > first_id, false)::INT AS E, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w JOIN m USING (t) LEFT JOIN y USING (doc_id)),
g AS (SELECT part, [A, B, C, D, E] AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, fails),
f AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step, o FROM o),
x AS (SELECT part, filter_order, step, o[step] AS own, n, good, toxic, fails[o[step]] = 1 AS fail, list_sum(fails) = 1 AND fails[o[step]] = 1 AS sole,
             len(list_filter(o[:step - 1], lambda i: fails[i] = 1)) > 0 AS gone FROM g, s),
r AS (SELECT part, filter_order, step, any_value(own) AS own,
             coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fail), 0) AS removed,
             coalesce(sum(n) FILTER (gone AND fail), 0) AS redundant, coalesce(sum(n) FILTER (sole), 0) AS unique_fails,
             coalesce(sum(good) FILTER (NOT gone AND fail), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fail), 0) AS toxic_lost
      FROM x GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""

OP13_SQL = """
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id AS id, a.label = x.label AS same, list_inner_product(a.v, x.v)::BIGINT AS score
      FROM v a, v x WHERE a.vec_id % 50 = 0 AND a.vec_id <> x.vec_id AND len(a.v) = len(x.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_decontamination": op5_decontamination,
        "op6_token_output": op6_token_output,
        "op7_url_filter": op7_url_filter,
        "op8_exact_top_k": op8_exact_top_k,
        "op9_html_extraction": op9_html_extraction,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
        "op11_filter_audit": op11_filter_audit,
        "op12_order_minhash": op12_order_minhash,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3_SQL, "op5_decontamination": OP5_SQL, "op8_exact_top_k": OP8_SQL, "op11_filter_audit": OP11_SQL, "op13_hard_negatives": OP13_SQL}
