"""The queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.session import Scratch, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.exact_names import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.minhash_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.template_decontam import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.fuzzy_lines import dedup_lines

    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record of ``pages``: where it lies, its digest, and whether the second replica still has it.

    The second replica is the written archive read back, with one byte changed in each record whose page_id leaves 13
    when divided by 97, as a disk might. The audit has to find exactly these.
    """
    from quarrymill.llm.merkle import archive, fixity_audit, leaves

    scratch = Scratch(spark)
    ours = scratch.table(archive(table(spark, sf_dir, "pages")), "archive")
    damaged = F.when(F.col("record_id") % 97 == 13, F.concat(F.expr("substring(record, 1, length(record) - 5)"), F.lit("#"), F.expr("substring(record, length(record) - 3)"))).otherwise(F.col("record"))
    theirs = ours.withColumn("record", damaged)
    bad = fixity_audit(ours, theirs, scratch).select("file", "place", F.lit(True).alias("bad"))
    found = leaves(ours).join(bad, ["file", "place"], "left")
    return found.select(F.col("record_id").alias("page_id"), "file", "offset", "length", "digest", F.coalesce("bad", F.lit(False)).alias("corrupt"))


def op6_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.ecoc_lang import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op7_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.crf_html import extract, fit

    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.recompress import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def token_digests(coded: DataFrame) -> DataFrame:
    """Counts and digests of ids and decoded bytes."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarrymill.llm.bpe import encode_decode

    return token_digests(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op10_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.ftrl import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.periodic_runs import periodic_runs, planted, run_digests

    return run_digests(periodic_runs(planted(table(spark, sf_dir, "documents"))))


def op12_onebit_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.onebit_negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.llm.minimax_shards import shards

    return shards(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_minhash_join": op2_minhash_join,
    "op3_template_decontam": op3_template_decontam,
    "op4_fuzzy_lines": op4_fuzzy_lines,
    "op5_merkle_fixity": op5_merkle_fixity,
    "op6_language_ecoc": op6_language_ecoc,
    "op7_html_crf": op7_html_crf,
    "op8_recompression": op8_recompression,
    "op9_bpe_tree": op9_bpe_tree,
    "op10_toxicity_ftrl": op10_toxicity_ftrl,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_onebit_negatives": op12_onebit_negatives,
    "op13_minimax_shards": op13_minimax_shards,
}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS len,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS kept,
               sha256(norm) AS text_sha256
        FROM n""",
    "op2_minhash_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS sh FROM d),
        u AS (SELECT doc_id, unnest(sh) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.sh) + len(y.sh) - c)),
        l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
        m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
        SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m USING (doc_id)""",
    "op8_recompression": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d),
        r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s + 19], ' ') ORDER BY doc_id, s) > 1 AS again FROM p),
        g AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE again) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)""",
    "op12_onebit_negatives": r"""
        WITH f AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, f.vec_id, f.label = a.label AS same, list_dot_product(a.v, f.v)::BIGINT AS score
            FROM f JOIN f a ON a.vec_id % 100 = 0),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        r AS (
            SELECT p.*, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, score AS negative_score
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5""",
}
