"""The queries over whole tables that this package registers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .chunk_dedup import remove_chunks
from .decontaminate import decontaminate
from .html_text import extract
from .minhash import near_duplicates
from .mixing import mix
from .pii import find_pii
from .quality import judge
from .secrets import scan
from .suffix_dedup import remove_repeats
from .toxicity import score


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op7_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op9_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_chunk_dedup(spark, sf_dir):
    return remove_chunks(table(spark, sf_dir, "documents"))


def op2_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


def op3_pii(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))


def op4_secrets(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("secrets", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "n_findings", "n_secrets", spans.alias("secrets"), F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"))


def op6_toxicity(spark, sf_dir):
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op8_quality(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_html_text, op3_pii, op4_secrets, op5_suffix_dedup, op6_toxicity, op7_mixing, op8_quality, op9_minhash, op10_chunk_dedup)
}
#: Windows of every length that the items have (10 words, or a shorter item's whole) at every place of a document.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[pos:pos + k - 1], ' ') AS gram
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS pos FROM (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0))
), places AS (
  SELECT doc_id, k, pos, array_to_string(w[pos:pos + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS pos FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), found AS (
  SELECT DISTINCT doc_id, k, pos, item_id FROM places JOIN windows USING (k, gram)
), hit AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS word FROM found) GROUP BY doc_id
), item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""
#: All pairs that share a shingle, compared on full sets, and everything that each document reaches.
OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[pos:pos + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS pos FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM shingle a JOIN shingle b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), link AS MATERIALIZED (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 75 * (x.n + y.n - same)
), reach AS (
  SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id::BIGINT AS component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
"""
#: All 200-byte strings (as hex) of whole texts; those that start twice, joined to runs, and what is left.
OP5_SQL = """
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), k AS (
  SELECT doc_id, p, md5_number(substring(h, 2 * p + 1, 400)) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS p FROM b WHERE n >= 200)
), d AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY g) AS c FROM k) WHERE c > 1
), island AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS s
  FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS fresh FROM d)
), span AS (
  SELECT doc_id, min(p) AS a, max(p) + 200 AS e FROM island GROUP BY doc_id, s
), gap AS (
  SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM span
), cut AS (
  SELECT doc_id, count(*) AS spans, sum(e - a) AS removed, string_agg(substring(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) || substring(any_value(h), 2 * max(e) + 1) AS kept
  FROM gap JOIN b USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM b LEFT JOIN cut USING (doc_id)
"""
ORACLES: dict[str, str] = {"op5_suffix_dedup": OP5_SQL, "op1_decontaminate": OP1_SQL, "op9_minhash": OP9_SQL}
