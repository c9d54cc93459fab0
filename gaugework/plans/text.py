"""Row functions on documents, pages and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.operators import textjobs
from gaugework.plans.registry import query
from gaugework.sources.tables import load


@query("fingerprint_rows", "SELECT md5(text) AS fp, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def fingerprint_rows(spark, sf):
    return textjobs.fingerprint_rows(load(spark, sf, "documents"), "text", "doc_id")


@query(
    "fingerprint_lists",
    """
SELECT page_id, md5(unhex(string_agg(md5('''' || part || ''''), '' ORDER BY place))) AS fp
FROM (SELECT page_id, unnest(string_split(url, '/')) AS part, generate_subscripts(string_split(url, '/'), 1) AS place
      FROM pages)
GROUP BY page_id
""",
)
def fingerprint_lists(spark, sf):
    parts = load(spark, sf, "pages").select("page_id", F.split("url", "/").alias("parts"))
    return textjobs.fingerprint_lists(parts, "parts").select("page_id", "fp")


@query(
    "grep_first_line",
    """
SELECT doc_id, list_filter(string_split(text, chr(10)), lambda line: contains(line, 'the'))[1] AS line FROM documents
""",
)
def grep_first_line(spark, sf):
    return textjobs.grep_first_line(load(spark, sf, "documents"), "text", "the").select("doc_id", "line")


@query(
    "filter_by_pattern",
    r"SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{2,4}')",
)
def filter_by_pattern(spark, sf):
    hits = textjobs.filter_by_pattern(load(spark, sf, "documents"), "text", "[0-9]{3}-[0-9]{2,4}")
    return hits.select("doc_id", "n_chars")


@query(
    "power2_histogram",
    """
SELECT CASE WHEN l_extendedprice > 0 THEN pow(2.0, trunc(log2(l_extendedprice) + 0.5)) END AS bucket, count(*) AS n
FROM lineitem GROUP BY 1
""",
)
def power2_histogram(spark, sf):
    return textjobs.power2_histogram(load(spark, sf, "lineitem"), "l_extendedprice")
