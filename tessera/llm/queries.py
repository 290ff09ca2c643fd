"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, fingerprint, langid, licenses, mixing, ngram_join, ngram_lm, suffix_dedup, toxicity, warc
from tessera.llm._spark import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"))


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "item_shingles", "shared", "containment")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_ngram_lm, op3_toxicity, op4_language_id, op5_mix_sources, op6_decontaminate, op7_fingerprint, op8_license_scan, op9_suffix_dedup, op10_warc)}


def _shingles(key: str, table_: str) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return f"""SELECT DISTINCT {key}, array_to_string(w[i + 1 : i + 5], ' ') AS s
        FROM (SELECT {key}, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM (SELECT {key}, {words} AS w FROM {table_}) WHERE len(w) > 0)"""


def _base32(x: str) -> str:
    """Base32 of 40 hexadecimal digits: four characters for each five of them."""
    five = (f"CAST('0x' || substr({x}, {5 * g + 1}, 5) AS INTEGER) >> {15 - 5 * k}" for g in range(8) for k in range(4))
    return " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({v}) & 31), 1)" for v in five)


#: Queries that SQL can express; the others are tested against brute force, round trips or held-out accuracy in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": f"""
        WITH RECURSIVE d AS MATERIALIZED ({_shingles("doc_id", "documents")}),
        n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
        links AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y
            FROM d a JOIN d b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
        reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
        least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
        counted AS (SELECT x, count(*) AS k FROM links GROUP BY x)
        SELECT o.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(o.doc_id, coalesce(least.y, o.doc_id)) AS component_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links
        FROM documents o LEFT JOIN n ON n.doc_id = o.doc_id LEFT JOIN least ON least.x = o.doc_id LEFT JOIN counted ON counted.x = o.doc_id""",
    "op6_decontaminate": f"""
        WITH d AS ({_shingles("doc_id", "documents")}), b AS ({_shingles("item_id", "benchmark")}),
        n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id)
        SELECT d.doc_id, b.item_id, n.item_shingles, count(*) AS shared, count(*) / CAST(n.item_shingles AS DOUBLE) AS containment
        FROM d JOIN b ON d.s = b.s JOIN n ON n.item_id = b.item_id
        GROUP BY d.doc_id, b.item_id, n.item_shingles HAVING count(*) >= 0.75 * n.item_shingles""",
    "op9_suffix_dedup": """
        WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM b WHERE len(h) >= 200)),
        later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
        steps AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM later),
        runs AS (SELECT doc_id, min(i) AS f, max(i) + 100 AS t FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM steps) GROUP BY doc_id, g),
        sums AS (SELECT doc_id, sum(t - f) AS n_removed, count(*) AS n_spans, max(t) AS t FROM runs GROUP BY doc_id),
        gaps AS (SELECT doc_id, coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY f), 0) AS f, f AS t FROM runs
            UNION ALL SELECT sums.doc_id, t, len(h) // 2 FROM sums JOIN b ON b.doc_id = sums.doc_id),
        kept AS (SELECT b.doc_id, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS h FROM gaps JOIN b ON b.doc_id = gaps.doc_id GROUP BY b.doc_id)
        SELECT b.doc_id, CAST(len(b.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
            sha256(unhex(coalesce(kept.h, b.h))) AS kept_sha256
        FROM b LEFT JOIN sums ON sums.doc_id = b.doc_id LEFT JOIN kept ON kept.doc_id = b.doc_id""",
    "op10_warc": f"""
        SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, {_base32("x")} AS payload_digest,
            CASE WHEN page_id = least_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least_id THEN least_id END AS refers_to
        FROM (SELECT page_id, html, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least_id FROM pages)""",
}
