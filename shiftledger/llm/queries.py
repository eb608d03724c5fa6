"""The operators as queries over the given tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger.llm import (
    align,
    centroids,
    grammar,
    impact,
    latent,
    licences,
    packing,
    quality,
    rangejoin,
    simhash,
    suffixes,
    urlrules,
    warc,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urlrules.filtered(table(spark, folder, "pages"))


def op3_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return impact.top_k(table(spark, folder, "embeddings"))


def op4_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.encoded(table(spark, folder, "documents"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents")).drop("ids")


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.removals(table(spark, folder, "documents"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return latent.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_warc_segments(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages"))


def op10_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scanned(table(spark, folder, "documents"))


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align.alignments(table(spark, folder, "documents"))


def op12_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.clustered(table(spark, folder, "embeddings"))


def op13_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return rangejoin.range_classes(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_token_ids": op4_token_ids,
    "op5_packing": op5_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_warc_segments": op9_warc_segments,
    "op10_license_scans": op10_license_scans,
    "op11_token_alignment": op11_token_alignment,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}


def _templates() -> str:
    """The licence templates as rows (id, label, base, size, place, word, in_key)."""
    rows = []
    for i, t in enumerate((*licences.BASE, *licences.MORE)):
        first, last = t.key_at
        base = str(i < len(licences.BASE)).lower()
        for place, word in enumerate(t.words):
            rows.append(f"({i}, '{t.label}', {base}, {len(t.words)}, {place}, '{word}', {int(first <= place < last)}, {last - first})")
    return ", ".join(rows)


def _rounds() -> str:
    """One pair of tables a round: a<i> assigns vectors to the centroids c<i>, c<i+1> are those after the round."""
    steps = []
    for i in range(centroids.ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
            SELECT r, min_by(number, (gap, number)) AS number, min(gap) AS gap FROM (
                SELECT r, number, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS gap
                FROM kept CROSS JOIN c{i}
            ) GROUP BY r
        )""")
        if i < centroids.ROUNDS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
            SELECT number, coalesce(moved, c) AS c FROM c{i} LEFT JOIN (
                SELECT number, list((((s - ((s % n) + n) % n) // n)::DOUBLE) ORDER BY place) AS moved FROM (
                    SELECT number, place, sum(v[place]::BIGINT) AS s, count(*) AS n
                    FROM a{i} JOIN kept USING (r) CROSS JOIN (SELECT unnest(range(1, {centroids.WIDTH + 1})) AS place)
                    GROUP BY number, place
                ) GROUP BY number
            ) USING (number)
        )""")
    return ", ".join(steps)


SQL: dict[str, str] = {
    "op3_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op6_substring_dedup": f"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d), s AS (
            SELECT r, i, w[i] AS word, CASE WHEN i + {suffixes.WINDOW - 1} <= len(w)
                THEN sha256(array_to_string(w[i : i + {suffixes.WINDOW - 1}], ' ')) END AS h
            FROM p
        ), f AS (SELECT r, i, word, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS again FROM s), g AS (
            SELECT r, i, word,
                bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS {suffixes.WINDOW - 1} PRECEDING) AS gone FROM f
        ), a AS (
            SELECT r, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY r
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN a USING (r)
    """,
    "op9_warc_segments": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
        ), f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
            CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (d)
    """,
    "op10_license_scans": f"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
                translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}'),
                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM documents
        ), o AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
        t(id, label, base, size, place, word, in_key, key_size) AS (VALUES {_templates()}), m AS (
            SELECT r, id, label, base, i - place AS word_at, count(*) / size::DOUBLE AS share
            FROM o JOIN t USING (word) GROUP BY r, id, label, base, word_at, size, key_size
            HAVING sum(in_key) = key_size AND share >= CASE WHEN base THEN 1 ELSE {licences.ENOUGH} END
        ), a AS (
            SELECT r, count(*) FILTER (base) AS n, min(word_at) FILTER (base) AS lo, max(word_at) FILTER (base) AS hi,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS b,
                string_agg(DISTINCT label, ',' ORDER BY label) AS l, max(share) AS s
            FROM m GROUP BY r
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word,
            hi::BIGINT AS last_word, coalesce(b, '') AS base_labels, coalesce(l, '') AS labels, coalesce(s, 0)::DOUBLE AS score
        FROM d LEFT JOIN a USING (r)
    """,    "op12_centroid_clusters": f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, row_number() OVER () AS r,
                list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)) AS v
            FROM embeddings WHERE len(embedding) = {centroids.WIDTH}
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h, v) - 1 AS number, v AS c FROM (
                SELECT v, sha256('{centroids.SEED}:' || vec_id::VARCHAR) AS h FROM kept WHERE vec_id IS NOT NULL
                ORDER BY h, v LIMIT {centroids.CENTROIDS}
            )
        ), {_rounds()}
        SELECT vec_id, number::INT AS cluster, gap::BIGINT AS distance,
            sum(gap) OVER (PARTITION BY number)::BIGINT AS cluster_inertia, sum(gap) OVER ()::BIGINT AS inertia,
            sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
        FROM kept JOIN a{centroids.ROUNDS} USING (r) JOIN c{centroids.ROUNDS} USING (number)
    """,
    "op13_embedding_near_dedup": f"""
        WITH RECURSIVE rows_ AS MATERIALIZED (
            SELECT vec_id, label, row_number() OVER () AS r, embedding::DOUBLE[] AS e FROM embeddings
        ), v AS MATERIALIZED (
            SELECT r, label, e, sqrt(list_inner_product(e, e)) AS norm FROM rows_
            WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), link AS MATERIALIZED (
            SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
            WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {rangejoin.COSINE}
        ), reach(a, b) AS (
            SELECT r, r FROM rows_ UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
        ), class AS (SELECT a AS r, min(vec_id) AS component_id FROM reach JOIN rows_ ON reach.b = rows_.r GROUP BY a),
        n AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
        FROM rows_ JOIN class USING (r) LEFT JOIN n USING (r)
    """,
}
