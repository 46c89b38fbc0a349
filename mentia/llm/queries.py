"""Queries of the problems on text, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mentia.llm import encode, history, language, mixing, reading, site_lines, style_tree
from mentia.session import cut
from mentia.sources.tables import table


def _page_documents(spark: SparkSession, root: str) -> DataFrame:
    raw = style_tree.documents_of(table(spark, root, "raw_content"), "raw_content", "raw_id", "url", "body")
    return raw.unionByName(style_tree.documents_of(table(spark, root, "normalized_content"), "normalized_content", "norm_id", "canonical_url", "text", "title"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """record_table, record_id of the pages and texts with residue in place of content."""
    return style_tree.extract(_page_documents(spark, root)).filter("residue").select("record_table", "record_id")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """record_table, record_id, line_no of the lines of the articles themselves."""
    found = style_tree.extract(_page_documents(spark, root)).filter("not residue")
    return found.select("record_table", "record_id", F.explode(F.col("lines").cast("array<bigint>")).alias("line_no"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """norm_id, line_no of the lines that a site repeats."""
    return site_lines.repeated_lines(table(spark, root, "normalized_content"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """record_table, record_id, line_no, lang_code of missing or wrong labels (line 0) and of foreign lines."""
    texts = table(spark, root, "normalized_content")
    pages = style_tree.documents_of(texts, "normalized_content", "norm_id", "canonical_url", "text", "title")
    # lines are counted over the same pages as in p2 and p3, so articles are the same
    judged = cut(language.foreign_and_main(pages, table(spark, root, "documents"), counted=_page_documents(spark, root)).filter("main is not null").select("record_id", "main", "foreign"))
    out = None
    for name, key in (("normalized_content", "norm_id"), ("classifications", "class_id")):
        tagged = table(spark, root, name).select(F.col(key).alias("id"), "norm_id", "language_tag") if key != "norm_id" else texts.select(F.col("norm_id").alias("id"), "norm_id", "language_tag")
        wrong = language.wrong_tags(tagged.join(judged.select(F.col("record_id").alias("norm_id"), "main"), "norm_id"), "language_tag", "main")
        rows = wrong.select(F.lit(name).alias("record_table"), F.col("id").alias("record_id"), F.lit(0).cast("bigint").alias("line_no"), F.col("main").alias("lang_code"))
        out = rows if out is None else out.unionByName(rows)
    foreign = judged.select("record_id", F.explode("foreign").alias("f")).select(F.lit("normalized_content").alias("record_table"), "record_id", F.col("f.line_no").cast("bigint").alias("line_no"), F.col("f.lang_code").alias("lang_code"))
    return out.unionByName(foreign)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """accepted_id, cand_id of the candidates that repeat something accepted: the first batch, then the later ones against it."""
    rows, store = table(spark, root, "ai_candidates"), history.Accepted(spark)
    # rows count in the order of their ids, so that any split of them gives the same
    until = rows.filter("batch_no = 1").agg(F.coalesce(F.max("cand_id"), F.lit(0))).first()[0]
    first = store.check(rows.filter(F.col("cand_id") <= until))
    return first.unionByName(store.check(rows.filter(F.col("cand_id") > until)))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """doc_id and token ids of every document."""
    return encode.encode_corpus(table(spark, root, "documents"))


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of documents in every slot of every mix."""
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and actual share of each source of each mix."""
    return mixing.shares(p9_mix(spark, root), table(spark, root, "mix_targets"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, band of every document with at least ten letters."""
    return reading.reading_bands(table(spark, root, "documents"), table(spark, root, "reading_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p7_found": p7_found, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL}


P4_SQL = r"""
WITH d AS (
  SELECT norm_id, canonical_url AS url, text,
    regexp_replace(regexp_extract(lower(trim(canonical_url)), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)', 1), '^(?:www|m)\.', '') AS site
  FROM normalized_content WHERE canonical_url IS NOT NULL),
l AS (
  SELECT norm_id, url, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM d WHERE text IS NOT NULL),
k AS (SELECT norm_id, url, site, line_no, replace(regexp_replace(lower(line), '[^\p{L}]+', '', 'g'), 'ß', 'ss') AS k FROM l),
n AS (SELECT site, count(DISTINCT url) AS total FROM d GROUP BY site),
f AS (
  SELECT k.site, k.k FROM k JOIN n ON n.site = k.site WHERE k.k <> ''
  GROUP BY k.site, k.k, n.total HAVING count(DISTINCT k.url) >= 5 AND count(DISTINCT k.url) >= 0.1 * n.total)
SELECT k.norm_id, CAST(k.line_no AS BIGINT) AS line_no FROM k JOIN f ON f.site = k.site AND f.k = k.k
"""
