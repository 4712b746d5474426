"""Queries of the numbered problems tagged llm, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm import body_text, cooccurrence, leakage, names, repeated_lines, residue, subjects, tokens, truncation
from tidewire.tables import table

#: Folder of the public vocabulary files, the same on every executor; the session's ``tidewire.tokenizers`` overrides it.
TOKENIZERS = "/opt/tokenizers"


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.variant_pairs(p1_entities(spark, sf))


def p1_entities(spark: SparkSession, sf: str) -> DataFrame:
    return names.groups(names.spellings(table(spark, sf, "extracted_entities")))


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    return residue.responses(table(spark, sf, "kafka_schema"), table(spark, sf, "pipeline_task1"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = _responses(spark, sf)
    parts = [residue.residue(table(spark, sf, t), found, key).select(F.lit(t).alias("table_name"), F.col(key).alias("row_id")) for t, key in (("kafka_schema", "msg_id"), ("pipeline_task1", "record_id"))]
    return parts[0].unionAll(parts[1])


def p2_clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages without those whose content is or holds residue."""
    pages = table(spark, sf, "pipeline_task1").select("record_id", "url", "source_name", "content")
    return residue.without_residue(pages, _responses(spark, sf), "record_id")


def _truncated(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(table(spark, sf, "kafka_schema"), _responses(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _truncated(spark, sf).select("msg_id", "field_name")


def p3_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.rates(table(spark, sf, "kafka_schema"), _truncated(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, sf, "pipeline_task1")).select("source_name", "line")


def p4_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pipeline_task1")
    return repeated_lines.without_lines(pages, repeated_lines.repeated_lines(pages))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return cooccurrence.more_than_chance(p5_pairs(spark, sf))


def p5_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return cooccurrence.together(cooccurrence.mentions(table(spark, sf, "extracted_entities")))


def p5_all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every two items that occur together, however seldom; ``p5_pairs`` has those of the thresholds of p5_found."""
    return cooccurrence.together(cooccurrence.mentions(table(spark, sf, "extracted_entities")), least=1, least_share=0.0)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """The lines outside the article body; ``p7_bodies`` gives what is inside."""
    pages = table(spark, sf, "pipeline_task1")
    return body_text.other_lines(pages, *body_text.train(spark)).select("record_id", "line_no")


def p7_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return body_text.body_texts(table(spark, sf, "pipeline_task1"), *body_text.train(spark))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    folder = spark.conf.get("tidewire.tokenizers", TOKENIZERS)
    return tokens.encode_ids(table(spark, sf, "documents"), f"{folder}/byte_bpe_50k.json")


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.shared_runs(_leaks(spark, sf))


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    """Each item with the number of documents that leak it."""
    counts = p9_found(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    items = table(spark, sf, "eval_items").select("item_id", "suite")
    return items.join(counts, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"))


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.subjects(*(table(spark, sf, t) for t in ("documents", "subject_areas", "subject_labels")))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _subjects(spark, sf).select("doc_id", "subject")


def p10_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of each subject by source, in number and as a share of the source's assignments.

    The window runs over the counts, a row for each source and subject.
    """
    found = _subjects(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    counted = found.groupBy("source", "subject").agg(F.count(F.lit(1)).alias("documents"))
    total = F.sum("documents").over(Window.partitionBy("source"))
    return counted.withColumn("share", F.col("documents") / total)


QUERIES = {
    "p1_found": p1_found,
    "p1_entities": p1_entities,
    "p2_found": p2_found,
    "p2_clean_pages": p2_clean_pages,
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p4_found": p4_found,
    "p4_pages": p4_pages,
    "p5_found": p5_found,
    "p5_pairs": p5_pairs,
    "p5_all_pairs": p5_all_pairs,
    "p7_found": p7_found,
    "p7_bodies": p7_bodies,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p10_shares": p10_shares,
}

_PAIRS = r"""
m AS (
  SELECT DISTINCT coalesce('u:' || url, 'r:' || entity_row_id) AS record, item FROM (
    SELECT url, entity_row_id, unnest(list_concat(
      list_transform(coalesce(people_mentioned, []), lambda x: 'people:' || trim(x, chr(32) || chr(9))),
      list_transform(coalesce(organizations_mentioned, []), lambda x: 'organizations:' || trim(x, chr(32) || chr(9))),
      list_transform(coalesce(locations_mentioned, []), lambda x: 'locations:' || trim(x, chr(32) || chr(9))))) AS item
    FROM extracted_entities) WHERE item IS NOT NULL AND NOT suffix(item, ':')
),
total AS (SELECT count(*)::BIGINT AS n_records FROM (SELECT DISTINCT coalesce('u:' || url, 'r:' || entity_row_id) FROM extracted_entities)),
c AS (SELECT item, count(*)::BIGINT AS n FROM m GROUP BY item),
ab AS (SELECT x.item AS item_a, y.item AS item_b, count(*)::BIGINT AS n_ab FROM m x JOIN m y ON x.record = y.record AND x.item < y.item GROUP BY ALL),
pairs AS (SELECT item_a, item_b, ca.n AS n_a, cb.n AS n_b, n_ab, n_records FROM ab JOIN c ca ON ca.item = item_a JOIN c cb ON cb.item = item_b, total
  WHERE n_ab >= 5 AND n_ab * 500 >= n_records)"""

_ALL_PAIRS = _PAIRS.replace("\n  WHERE n_ab >= 5 AND n_ab * 500 >= n_records", "")

_LINES = r"""
lines AS (
  SELECT record_id, source_name, url, k, raw,
    regexp_replace(lower(trim(regexp_replace(raw, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))), '[0-9]+', '#', 'g') AS line
  FROM (SELECT record_id, source_name, url, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS k FROM pipeline_task1)
),
urls AS (SELECT source_name, count(DISTINCT url)::BIGINT AS urls FROM pipeline_task1 WHERE source_name <> 'N/A' GROUP BY source_name),
repeated AS (
  SELECT source_name, line FROM lines JOIN urls USING (source_name) WHERE line <> ''
  GROUP BY source_name, line, urls HAVING count(DISTINCT url) >= 3 AND count(DISTINCT url) * 25 >= urls)"""

_LEAKS = r"""
words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
spans AS (SELECT doc_id, array_to_string(w[i + 1:i + 12], ' ') AS span FROM (SELECT doc_id, w, unnest(range(0, len(w) - 11)) AS i FROM words)),
item_spans AS (SELECT item_id, array_to_string(w[i + 1:i + 12], ' ') AS span FROM (SELECT item_id, w, unnest(range(0, len(w) - 11)) AS i FROM item_words)),
leaks AS (SELECT DISTINCT doc_id, item_id FROM spans JOIN item_spans USING (span))"""

SQL = {
    "p4_found": f"WITH {_LINES} SELECT source_name, line FROM repeated",
    "p4_pages": f"""WITH {_LINES},
        kept AS (SELECT record_id, string_agg(raw, chr(10) ORDER BY k) FILTER (r.line IS NULL) AS content, count(r.line)::INTEGER AS removed
          FROM lines l LEFT JOIN repeated r ON r.source_name = l.source_name AND r.line = l.line GROUP BY record_id)
        SELECT p.record_id, CASE WHEN p.content IS NULL THEN NULL ELSE coalesce(kept.content, '') END AS content, coalesce(removed, 0)::INTEGER AS removed
        FROM pipeline_task1 p LEFT JOIN kept USING (record_id)""",
    "p9_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM leaks",
    "p9_items": f"""WITH {_LEAKS} SELECT item_id, suite, count(doc_id)::BIGINT AS documents FROM eval_items LEFT JOIN leaks USING (item_id) GROUP BY item_id, suite""",
    "p5_found": f"WITH {_PAIRS} SELECT item_a, item_b FROM pairs WHERE n_ab * n_records >= 4 * n_a * n_b",
    "p5_pairs": f"""WITH {_PAIRS} SELECT *, n_ab::DOUBLE * n_records / (n_a::DOUBLE * n_b) AS lift,
        ln(((n_ab + 0.5::DOUBLE) * (n_records - n_a - n_b + n_ab + 0.5::DOUBLE)) / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE))) AS log_odds FROM pairs""",
    "p5_all_pairs": f"""WITH {_ALL_PAIRS} SELECT *, n_ab::DOUBLE * n_records / (n_a::DOUBLE * n_b) AS lift,
        ln(((n_ab + 0.5::DOUBLE) * (n_records - n_a - n_b + n_ab + 0.5::DOUBLE)) / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE))) AS log_odds FROM pairs""",
}
