"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplanes, jaccard_join, labelled_urls, language_id, line_dedup, media, mix, packing, pii, syncmers, url_filter
from .common import table

BOILERPLATE_RATIO, BOILERPLATE_PAGES = 0.05, 3


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = line_dedup.drop_boilerplate(docs, ratio=BOILERPLATE_RATIO, min_pages=BOILERPLATE_PAGES, report=True)
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edit_report(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table labels URLs: the model learns from the small table of ``labelled_urls``."""
    labelled = spark.createDataFrame(labelled_urls.table(), "url string, block int")
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.train(labelled))


def op4_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_texts(table(spark, sf_dir, "documents"))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the key in the file that ``spark.tessera.pii.keyFile`` names; tests and the benchmark name none and use the demo key."""
    return pii.pseudonymize(table(spark, sf_dir, "documents"), key_file=spark.conf.get("spark.tessera.pii.keyFile", None))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out()
    model = language_id.learn(docs.filter(~held))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", F.size("languages").cast("long").alias("n_languages"))


def op7_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.round_trip(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix.mix(table(spark, sf_dir, "documents"))
    copies = F.coalesce(F.size("positions"), F.lit(0)).cast("long")
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 6).alias("position"), F.greatest(copies, F.lit(0)).alias("copies"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_line_dedup, op2_syncmer_fingerprints, op3_url_filter, op4_media_sniffing, op5_pii_pseudonyms, op6_language_id, op7_bitplane_ids, op8_packing, op9_curriculum_mix, op10_jaccard_join, pipeline)
    return {f.__name__: f for f in own}


_BLANKS = r"' ' || chr(9) || chr(13) || chr(12) || chr(11)"

LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, text, p.n AS n, string_split(text, chr(10))[p.n] AS line
  FROM documents, LATERAL (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS n) p
), per AS (
  SELECT source, trim(line, {_BLANKS}) AS line, count(DISTINCT doc_id) AS pages
  FROM lines WHERE trim(line, {_BLANKS}) <> '' GROUP BY 1, 2
), hosts AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1
), bad AS (
  SELECT per.source, per.line FROM per JOIN hosts ON per.source IS NOT DISTINCT FROM hosts.source
  WHERE per.pages >= {BOILERPLATE_PAGES} AND per.pages > hosts.pages * {BOILERPLATE_RATIO}::DOUBLE
), judged AS (
  SELECT l.doc_id, l.n, l.line, b.line IS NOT NULL AS drop_it
  FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line, {_BLANKS}) = b.line
), sums AS (
  SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (drop_it))::BIGINT AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT drop_it), '') AS clean
  FROM judged GROUP BY 1
)
SELECT d.doc_id, d.source, coalesce(s.n_lines, 0)::BIGINT AS n_lines, coalesce(s.n_dropped, 0)::BIGINT AS n_dropped,
       CASE WHEN d.text IS NOT NULL THEN sha256(s.clean) END AS text_sha256
FROM documents d LEFT JOIN sums s USING (doc_id)
"""


_WORD = r"'[^\x20\x09-\x0D]+'"

#: Shingle sets, all pairs that share a shingle, and the smallest doc_id that links reach.
JACCARD_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), tok AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), met AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS p, b.n AS q, count(*) AS c FROM tok a JOIN tok b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4
), link AS (SELECT x, y FROM met WHERE 100 * c >= 75 * (p + q - c)
), both_ AS (SELECT x, y FROM link UNION SELECT y, x FROM link
), reach(node, root) AS (SELECT x, x FROM both_ UNION SELECT b.y, r.root FROM reach r JOIN both_ b ON b.x = r.node WHERE r.root < b.y
), least_ AS (SELECT node, min(root) AS root FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(l.root, s.doc_id) AS component_id FROM sets s LEFT JOIN least_ l ON l.node = s.doc_id
"""

#: The level at which capped targets sum to all sizes, streams in hash order, inverted schedules.
MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD}))::BIGINT AS size, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents
), per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1
), ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM per
), src AS (SELECT source, source_size, [1.0::DOUBLE, 2.0, 3.0][k + 1] AS weight, [-0.5::DOUBLE, 0.0, 0.5][k + 1] AS slope, 3 * source_size AS cap FROM ranked
), s AS (
  SELECT *, cap / weight AS full_at, sum(cap) OVER o AS capped, sum(weight) OVER () - sum(weight) OVER o AS open_, sum(source_size) OVER () AS all_
  FROM src WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), levels AS (
  SELECT 0::DOUBLE AS below, max(all_)::DOUBLE / sum(weight) AS level, min(full_at) AS upto FROM s
  UNION ALL SELECT full_at, (all_ - capped)::DOUBLE / open_, lead(full_at) OVER (ORDER BY full_at, source NULLS LAST) FROM s WHERE open_ > 0
), level AS (SELECT arg_min(level, below) AS level FROM levels WHERE upto IS NULL OR level <= upto
), t AS (SELECT source, source_size, slope, least(cap::DOUBLE, level * weight) AS target FROM src, level
), p AS (
  SELECT d.*, t.source_size, t.slope, t.target, floor(t.target)::BIGINT AS words,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes FROM p
), k AS (
  SELECT *, passes * size + greatest(0, least(size, words - passes * source_size - before_)) AS taken, least(before_ / greatest(words, 1), 1.0::DOUBLE) AS share FROM g
)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken::BIGINT AS taken,
       CASE WHEN taken > 0 THEN round(least(abs(CASE WHEN slope = 0 THEN share ELSE (sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * share, 0.0)) - (1 - slope)) / (2 * slope) END), 1.0), 6) END AS position,
       CASE WHEN taken > 0 THEN ceil(taken / size)::BIGINT ELSE 0 END AS copies
FROM k
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINE_DEDUP_SQL, "op9_curriculum_mix": MIX_SQL, "op10_jaccard_join": JACCARD_SQL}
