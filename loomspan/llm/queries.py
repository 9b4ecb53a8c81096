"""Queries of this subpackage: each applies one operator, with its production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import audit, bpe, decontaminate, exact, licenses, ngrams, pii, quality, search, shards, simhash, substring, toxicity
from loomspan.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabularies are installed; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), length=35, digest=True)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_pii(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, held=1)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score_texts(table(spark, sf_dir, "documents"), folds=10, held=0)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), words_per_shingle=4, within=4)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(table(spark, sf_dir, "documents"), shards=40)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held=0)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=5, share=0.8)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), least_words=200)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_substring_dedup, op2_pii, op3_toxicity, op4_lm_scoring, op5_exact_dedup, op6_simhash, op7_sharding, op8_quality, op9_decontamination, op10_bpe, op11_search, op12_filter_audit, op13_licenses)}

ORACLE: dict[str, str] = {
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
             g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT d.doc_id, g.keep_id, g.group_size, row_number() OVER (PARTITION BY d.body ORDER BY d.doc_id DESC NULLS LAST) = 1 AS kept, sha256(d.body) AS text_sha256
        FROM d JOIN g ON d.body = g.body""",
    "op11_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
             q AS (SELECT row_number() OVER () AS i, item_id, text FROM benchmark),
             s AS (SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM q),
             size AS (SELECT r, count(*) AS n FROM d GROUP BY r),
             total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
             tf AS (SELECT r, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
             df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
             w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, total),
             p AS (SELECT tf.r, tf.doc_id, tf.term, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * size.n * n_docs) // n_terms))) AS gain
                   FROM tf JOIN size ON tf.r = size.r JOIN w ON tf.term = w.term, total),
             found AS (SELECT s.i, s.item_id, p.r, p.doc_id, sum(p.gain)::BIGINT AS score FROM s JOIN p ON s.term = p.term GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
        FROM found WHERE score > 0 QUALIFY rank <= 20""",
    "op12_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
             j AS (SELECT part,
                          ((len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
                           + 4 * (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body))::INT + 8 * regexp_matches(body, '[#$%&*|]')::INT
                           + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), FALSE)::INT) AS fails,
                          coalesce(l.good, FALSE) AS good, coalesce(l.toxic, FALSE) AS toxic
                   FROM t LEFT JOIN (SELECT doc_id AS id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON t.doc_id = l.id),
             p AS (SELECT part, fails, good, toxic, count(*) AS n FROM j GROUP BY ALL),
             c AS (SELECT i, substr('ABCDE', i + 1, 1) AS letter, (1 << i) AS bit FROM range(5) r(i)),
             o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
                   FROM c a, c b, c c, c d, c e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
             s AS (SELECT filter_order, k::INT AS step, bits[k] AS bit, list_sum(bits[1:k - 1])::INT AS before FROM o, range(1, 6) r(k)),
             x AS (SELECT part, filter_order, step, bit,
                          coalesce(sum(n) FILTER (fails & coalesce(before, 0) = 0 AND fails & bit = 0), 0)::BIGINT AS kept,
                          coalesce(sum(n) FILTER (fails & coalesce(before, 0) = 0 AND fails & bit <> 0), 0)::BIGINT AS removed,
                          coalesce(sum(n) FILTER (fails & coalesce(before, 0) <> 0 AND fails & bit <> 0), 0)::BIGINT AS redundant,
                          coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
                          coalesce(sum(n) FILTER (fails & coalesce(before, 0) = 0 AND fails & bit <> 0 AND good), 0)::BIGINT AS good_lost,
                          coalesce(sum(n) FILTER (fails & coalesce(before, 0) = 0 AND fails & bit <> 0 AND toxic), 0)::BIGINT AS toxic_lost
                   FROM p, s GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM x""",
}
