"""The queries of problems 4, 6, 7 and 8."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.llm import mixture, packing, prose, terms
from terrane.plans.registry import Tables, query

SQL_TERMS = r"""
WITH decl AS (SELECT DISTINCT id AS layer, field FROM (SELECT id, unnest(map_entries(fields)) AS e FROM vector_layers) x, LATERAL (SELECT e.key AS field, e.value AS kind) y WHERE kind = 'String'),
val AS (SELECT DISTINCT attr_id, field_name, feature_id, string_value FROM layer_attrs JOIN decl ON decl.layer = layer_attrs.layer AND decl.field = field_name
  WHERE string_value IS NOT NULL AND string_value <> '' AND feature_id IS NOT NULL),
total AS (SELECT field_name, count(DISTINCT feature_id) AS field_records FROM val GROUP BY field_name),
term AS (SELECT field_name, feature_id, unnest(regexp_extract_all(lower(string_value), '[\p{L}\p{Nd}]+')) AS term FROM val),
counted AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT feature_id) AS records FROM term GROUP BY ALL)
SELECT {columns} FROM (SELECT field_name, term, occurrences, records, field_records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.1 * field_records THEN 'common' ELSE 'useful' END AS verdict FROM counted JOIN total USING (field_name)) {where}
"""
SQL_TERMS_FOUND = SQL_TERMS.replace("{columns}", "field_name, term, verdict").replace("{where}", "WHERE verdict <> 'useful'")
SQL_TERMS_ALL = SQL_TERMS.replace("{columns}", "field_name, term, occurrences, records, field_records, verdict").replace("{where}", "")


def _terms(t: Tables):
    declared = t("vector_layers").select(F.col("id").alias("layer"), F.explode("fields").alias("field", "kind")).filter("kind = 'String'").select("layer", "field")
    attrs = t("layer_attrs")
    values = attrs.select(F.col("attr_id").alias("key"), "layer", F.col("field_name").alias("field"), F.col("feature_id").alias("record"), F.col("string_value").alias("value"))
    return terms.marked(terms.term_counts(values, declared, rows=attrs.count())).withColumnRenamed("field", "field_name")


@query("p4_found", SQL_TERMS_FOUND)
def p4_found(t: Tables):
    return _terms(t).filter("verdict != 'useful'").select("field_name", "term", "verdict")


@query("p4_terms", SQL_TERMS_ALL)
def p4_terms(t: Tables):
    return _terms(t).select("field_name", "term", "occurrences", "records", "field_records", "verdict")


@query("p6_containers")
def p6_containers(t: Tables):
    return packing.pack(packing.document_lengths(t("documents")))


@query("p6_fill")
def p6_fill(t: Tables):
    return packing.fill_report(packing.pack(packing.document_lengths(t("documents"))))


@query("p6_fill_inside_buckets")
def p6_fill_inside_buckets(t: Tables):
    """Room left by the number of length buckets."""
    return packing.fill_by_buckets(packing.document_lengths(t("documents")))


@query("p7_mixture")
def p7_mixture(t: Tables):
    return mixture.mixture(mixture.sized_texts(t("documents")), t("mix_targets"))[0]


@query("p7_shares")
def p7_shares(t: Tables):
    return mixture.share_report(*mixture.mixture(mixture.sized_texts(t("documents")), t("mix_targets")))


def _statistics(t: Tables):
    words = [tuple(r) for r in t("common_words").select("lang", "word", "word_rank").groupBy("lang", "word").agg(F.min("word_rank")).limit(8 * prose.MAX_WORDS_PER_LANGUAGE + 1).collect()]  # a list of bounded length, checked by Profiles
    return prose.text_statistics(t("documents"), words)


@query("p8_found")
def p8_found(t: Tables):
    return _statistics(t).filter("form in ('list', 'table', 'junk')").select("doc_id", "form")


@query("p8_statistics")
def p8_statistics(t: Tables):
    return _statistics(t)
