"""Queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A public tokenizer's file; the path is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumine.llm.near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumine.llm.language_id import identify_languages, language_model

    docs = table(spark, sf_dir, "documents")
    return identify_languages(docs, language_model(docs))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumine.llm.token_store import token_store

    return token_store(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumine.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumine.llm.bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fractions import Fraction

    from vellumine.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=4, least=Fraction(85, 100))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumine.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumine.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumine.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumine.llm.lattice_lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_REACHED = "r(a, b) AS (SELECT id, id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_vectors": f"""
            WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
            n AS (SELECT vec_id AS id FROM embeddings),
            l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
            {_REACHED}
            SELECT c.a AS vec_id, (SELECT count(*) FROM l WHERE l.a = c.a) AS n_links, component_id, c.a = component_id AS kept FROM c""",
        "op6_ngram_join": f"""
            WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
            n AS (SELECT doc_id AS id FROM documents),
            s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
            k AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
            p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
            q AS (SELECT p.a, p.b FROM p JOIN k ka ON ka.doc_id = p.a JOIN k kb ON kb.doc_id = p.b WHERE 100 * shared >= 85 * (ka.size + kb.size - shared)),
            l AS (SELECT a, b FROM q UNION ALL SELECT b, a FROM q),
            {_REACHED}
            SELECT c.a AS doc_id, coalesce(size, 0) AS n_shingles, component_id FROM c LEFT JOIN k ON k.doc_id = c.a""",
        "op9_exact_dedup": f"""
            WITH d AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
            g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
            SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
            FROM d JOIN g ON d.norm = g.norm""",
    }
