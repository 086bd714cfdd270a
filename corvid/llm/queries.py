"""The queries over the corpus tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvid.llm.common import table


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm import exact_dedup

    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op2_crf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm import html_extract

    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm import repeats

    return repeats.removed(table(spark, sf_dir, "documents"))


def op5_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm import mixing

    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm import quality

    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm import archive

    index = archive.write(table(spark, sf_dir, "pages"))
    return archive.read(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm import scoring

    return scoring.scored(table(spark, sf_dir, "documents"))


def op9_size_aware_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm import jaccard

    return jaccard.joined(table(spark, sf_dir, "documents"))


def op10_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm import media

    return media.digests(media.stored(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_curve_packing": op1_curve_packing,
    "op2_crf_text": op2_crf_text,
    "op4_recompression": op4_recompression,
    "op5_raked_mix": op5_raked_mix,
    "op6_bradley_terry": op6_bradley_terry,
    "op7_warc_index": op7_warc_index,
    "op8_bloom_lm": op8_bloom_lm,
    "op9_size_aware_join": op9_size_aware_join,
    "op10_iso_media": op10_iso_media,
    "op3_exact_dedup": op3_exact_dedup,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op4_recompression": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35),
        h AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
        r AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
        x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM x ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN k USING (doc_id)
    """,
    "op9_size_aware_join": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
        -- Equal sets are one node, named by the smallest doc_id.
        m AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS rep, s FROM s),
        u AS (SELECT doc_id, n, unnest(s) AS g FROM m WHERE rep = doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM c WHERE 100 * c >= 85 * (nx + ny - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        t(node, root) AS (SELECT rep, rep FROM m UNION SELECT e.y, t.root FROM t JOIN e ON e.x = t.node),
        o AS (SELECT node, min(root) AS root FROM t GROUP BY node)
        SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, root AS component_id FROM m JOIN o ON node = rep
    """,
    "op7_warc_index": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        q AS (SELECT page_id, strlen(h) AS payload_bytes, payload_digest,
                     max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
        FROM q
    """,
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER g AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER g AS kept,
               text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
    """,
}
