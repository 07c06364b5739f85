"""The registered queries of this subpackage, each over its whole table, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import bpe_codec, exact_search, lm_scoring, mixing, ngram_jaccard, personal_data, quality_classifier, quality_rules, substring_dedup, token_shards, url_filter, vector_codes, whitening
from tablescope.llm.shared import scratch_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_join(read(spark, sf_dir, "documents"))


def op2_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_k(read(spark, sf_dir, "embeddings"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.find_personal_data(read(spark, sf_dir, "documents")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_windows(read(spark, sf_dir, "documents"), with_text=False)


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.round_trip(read(spark, sf_dir, "documents"), scratch_path(spark, "token-shards"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digest_documents(read(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = vector_codes.compress(read(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.lit(vector_codes.codebooks_text(codebooks)), 256)
    return codes.select(F.col("key").alias("vec_id"), "code", "error", "label_error", digest.alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_exact_search": op2_exact_search,
    "op3_personal_data": op3_personal_data,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_source_mixing": op5_source_mixing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_shards": op7_token_shards,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_quality_rules": op9_quality_rules,
    "op10_bpe": op10_bpe,
    "op11_url_filter": op11_url_filter,
    "op12_whitening": op12_whitening,
    "op13_vector_codes": op13_vector_codes,
}

#: Words as in every operator: maximal runs outside ASCII white space.
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: Kept vectors as integers of a scale.
INTEGERS = """
        SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _assigned(number: int) -> str:
    """Each part's nearest entry of codebook c<number>, and its squared distance."""
    distance = "list_sum(list_transform(list_zip(p.y, c.y), lambda q: (q[1] - q[2]) * (q[1] - q[2])))"
    return f"""
        d{number} AS (SELECT p.vec_id, p.label, p.part, p.y, c.entry, CAST({distance} AS BIGINT) AS d FROM p JOIN c{number} c USING (part)),
        a{number} AS (SELECT * FROM d{number} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)"""


def _moved(number: int) -> str:
    """Codebook c<number + 1>: floors of the means, unused entries as they were."""
    return f"""
        m{number} AS (SELECT part, entry, i, floor(sum(y[i])::DOUBLE / count(*))::BIGINT AS v
            FROM a{number}, (SELECT unnest(range(1, (SELECT max(len(y)) FROM p) + 1)) AS i) GROUP BY part, entry, i),
        c{number + 1} AS (SELECT c.part, c.entry, coalesce(n.y, c.y) AS y FROM c{number} c
            LEFT JOIN (SELECT part, entry, list(v ORDER BY i) AS y FROM m{number} GROUP BY part, entry) n USING (part, entry))"""


SQL: dict[str, str] = {
    "op2_exact_search": """
        WITH v AS (
            SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            GROUP BY vec_id),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
    "op6_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS s, w FROM d WHERE len(w) >= 35),
        h AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 34], ' ')) AS h FROM p),
        c AS (SELECT doc_id, unnest(range(s, s + 35)) AS i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
        g AS (SELECT doc_id, list(DISTINCT i) AS gone FROM c GROUP BY doc_id),
        k AS (SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
                list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS kept FROM d LEFT JOIN g USING (doc_id))
        SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op11_url_filter": """
        WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        u AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
        h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
        rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(rule_host, rule_path, verdict)),
        f AS (SELECT h.page_id, h.host, h.path, rule_host || rule_path AS rule, verdict FROM h
            LEFT JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1""",
    "op13_vector_codes": f"""
        WITH v AS ({INTEGERS.format(scale=256)}),
        p AS (SELECT vec_id, label, part, x[part * (len(x) // 16) + 1 : (part + 1) * (len(x) // 16)] AS y FROM v, (SELECT unnest(range(16)) AS part)),
        c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, y FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
        {_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
        e AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
        b AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, b""",
}
