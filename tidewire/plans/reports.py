"""Queries of the document reports and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import reports as R
from tidewire.tables import table


def _over(report, *args, **kwargs):
    return lambda spark, sf: report(table(spark, sf, "enriched_sentences"), *args, **kwargs)


QUERIES = {
    "r_daily_report": _over(R.daily),
    "r_positive_by_article": _over(R.strong_by_title, "positive"),
    "r_negative_by_article": _over(R.strong_by_title, "negative"),
    "r_positive_sentences": _over(R.sentences_of, "positive"),
    "r_negative_sentences": _over(R.sentences_of, "negative"),
    "r_keyword_sentence_rows": _over(R.keyword_rows, ["dividend", "trunk line", "court"], "2024-01-01T00:00:00Z", "2024-05-31T23:59:59Z"),
    "r_keyword_urls": _over(R.keyword_urls, "terminal|market|gas"),
    "r_location_articles": _over(R.with_location, "Port Selandar", "Kuala Tembusu", 50),
    "r_top_categories": _over(R.top_categories, "positive", 5),
    "r_by_published_date": _over(R.by_published, 40, "2024-02-01T00:00:00Z", "2024-04-30T23:59:59Z"),
    "r_mixed_sentiment": _over(R.mixed),
    "r_top_positive": _over(lambda s: R.top_titles(s, F.col("sentiment_label") == "positive", "positive_count")),
    "r_top_negative": _over(lambda s: R.top_titles(s, F.col("Sentiment_Result") <= -2, "negative_count")),
    "r_keyword_search": _over(R.keyword_search, "terminal|market|gas"),
    "r_keyword_sentences": _over(R.keyword_sentences, ["dividend", "trunk line", "court"], 25, "2024-01-01T00:00:00Z", "2024-05-31T23:59:59Z"),
    "r_source_summary": _over(R.source_summary),
    "r_totals": _over(R.totals),
    "r_total_sentences": _over(lambda s: R.totals(s).select("sentences")),
    "r_unique_titles": _over(lambda s: R.totals(s).select("titles")),
    "r_collection_stats": _over(R.collection_stats),
    "r_monthly_distribution": _over(R.monthly, "2024-01-15T00:00:00Z", "2024-06-15T23:59:59Z"),
    "r_sentiment_distribution": lambda spark, sf: R.distribution(R.labelled(table(spark, sf, "enriched_sentences")), "sentiment_label"),
    "r_top_sources": lambda spark, sf: R.top_share(table(spark, sf, "enriched_sentences"), "source", 5),
}

_L = "l AS (SELECT *, CASE WHEN Sentiment_Result > 0 THEN 'positive' WHEN Sentiment_Result = 0 THEN 'neutral' ELSE 'negative' END AS sentiment_label FROM enriched_sentences)"
_COUNTS = ", ".join(f"count(*) FILTER (sentiment_label = '{x}') AS {x}_count" for x in R.LABELS)
_SHARES = ", ".join(f"{x}_count * 100.0::DOUBLE / sentences AS {x}_percent" for x in R.LABELS)
_SET = "list_sort(list(DISTINCT {0}) FILTER ({0} IS NOT NULL))"


def _set(c: str) -> str:
    return f"coalesce({_SET.format(c)}, [])"


def _strong(label: str, sign: str, one: int) -> str:
    return f"""WITH {_L} SELECT cleaned_title, count(*) AS sentences, avg(Sentiment_Result) AS average_sentiment,
        count(*) FILTER (Sentiment_Result = {one}) AS weak_count, count(*) FILTER (Sentiment_Result = {2 * one}) AS strong_count
        FROM l WHERE sentiment_label = '{label}' AND Sentiment_Result {sign} 0 GROUP BY cleaned_title"""


_MOMENT = "try_strptime(publishedAt, '%Y-%m-%dT%H:%M:%SZ')"

SQL = {
    "r_daily_report": f"""WITH {_L}, g AS (SELECT substr(publishedAt, 1, 10) AS day, cleaned_title AS title, count(*) AS sentences, avg(Sentiment_Result) AS average_sentiment, {_COUNTS} FROM l GROUP BY 1, 2)
        SELECT *, {_SHARES} FROM g""",
    "r_positive_by_article": _strong("positive", ">", 1),
    "r_negative_by_article": _strong("negative", "<", -1),
    "r_positive_sentences": "SELECT sentence_id, cleaned_title, sentence, Sentiment_Result FROM enriched_sentences WHERE Sentiment_Result > 0",
    "r_location_articles": f"""WITH {_L} SELECT sentence_id, cleaned_title AS title, cleaned_description, publishedAt, sentiment_label, sentence FROM l
        WHERE sentiment_label IN ('neutral', 'positive') AND list_has_any(locations_mentioned, ['Port Selandar', 'Kuala Tembusu'])
        ORDER BY publishedAt DESC NULLS LAST, sentence_id LIMIT 50""",
    "r_top_categories": f"WITH {_L} SELECT category, count(*) AS count FROM l WHERE sentiment_label = 'positive' GROUP BY category ORDER BY count DESC, category NULLS FIRST LIMIT 5",
    "r_by_published_date": f"""WITH {_L} SELECT cleaned_title, cleaned_description, {_set('sentiment_label')} AS labels, {_set('source')} AS sources, {_set('category')} AS categories,
        arg_min_null(publishedAt, sentence_id) AS publishedAt, arg_min_null(url, sentence_id) AS url, count(*) AS sentences, avg(Sentiment_Result) AS average_sentiment
        FROM l WHERE publishedAt BETWEEN '2024-02-01T00:00:00Z' AND '2024-04-30T23:59:59Z' GROUP BY cleaned_title, cleaned_description
        ORDER BY arg_min_null(publishedAt, sentence_id) DESC NULLS LAST, cleaned_title NULLS FIRST, cleaned_description NULLS FIRST LIMIT 40""",
    "r_mixed_sentiment": f"""WITH {_L}, g AS (SELECT cleaned_title, count(*) AS sentences, {_COUNTS}, {_set('source')} AS sources, count(DISTINCT url) AS urls, arg_min_null(publishedAt, sentence_id) AS publishedAt
        FROM l GROUP BY cleaned_title) SELECT *, {_SHARES} FROM g WHERE (positive_count > 0)::INT + (neutral_count > 0)::INT + (negative_count > 0)::INT > 1""",
    "r_top_positive": "SELECT cleaned_title, count(*) AS positive_count FROM enriched_sentences WHERE Sentiment_Result > 0 GROUP BY cleaned_title ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 10",
    "r_top_negative": "SELECT cleaned_title, count(*) AS negative_count FROM enriched_sentences WHERE Sentiment_Result <= -2 GROUP BY cleaned_title ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 10",
    "r_negative_sentences": "SELECT sentence_id, cleaned_title, sentence, Sentiment_Result FROM enriched_sentences WHERE Sentiment_Result < 0",
    "r_keyword_sentence_rows": f"""WITH {_L} SELECT sentence_id, cleaned_title, sentence, sentiment_label FROM l
        WHERE regexp_matches(sentence, '(?i)dividend|trunk line|court') AND publishedAt BETWEEN '2024-01-01T00:00:00Z' AND '2024-05-31T23:59:59Z'""",
    "r_keyword_urls": """SELECT DISTINCT cleaned_title, url FROM enriched_sentences WHERE url IS NOT NULL
        AND (regexp_matches(cleaned_title, '(?i)terminal|market|gas') OR regexp_matches(cleaned_description, '(?i)terminal|market|gas'))""",
    "r_keyword_search": f"""WITH {_L} SELECT cleaned_title, {_COUNTS}, {_set('sentiment_label')} AS labels, {_set('source')} AS sources, count(DISTINCT url) AS urls FROM l
        WHERE regexp_matches(cleaned_title, '(?i)terminal|market|gas') OR regexp_matches(cleaned_description, '(?i)terminal|market|gas') GROUP BY cleaned_title""",
    "r_keyword_sentences": f"""WITH {_L} SELECT cleaned_title, count(*) AS sentences, {', '.join(f'arg_min_null({c}, sentence_id) AS {c}' for c in ('sentiment_label', 'publishedAt', 'source', 'url'))} FROM l
        WHERE regexp_matches(sentence, '(?i)dividend|trunk line|court') AND publishedAt BETWEEN '2024-01-01T00:00:00Z' AND '2024-05-31T23:59:59Z'
        GROUP BY cleaned_title ORDER BY arg_min_null(publishedAt, sentence_id) DESC NULLS LAST, cleaned_title NULLS FIRST LIMIT 25""",
    "r_source_summary": f"""WITH {_L}, g AS (SELECT source, count(DISTINCT cleaned_title) + max(CASE WHEN cleaned_title IS NULL THEN 1 ELSE 0 END) AS articles, count(*) AS sentences, avg(Sentiment_Result) AS average_sentiment, {_COUNTS} FROM l GROUP BY source),
        t AS (SELECT source, category AS top_category, n AS top_category_sentences FROM (SELECT source, category, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, category NULLS LAST) AS k FROM l GROUP BY source, category) WHERE k = 1)
        SELECT g.*, {_SHARES}, top_category, top_category_sentences FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source""",
    "r_totals": "SELECT count(*) AS sentences, count(DISTINCT cleaned_title) + max(CASE WHEN cleaned_title IS NULL THEN 1 ELSE 0 END) AS titles FROM enriched_sentences",
    "r_total_sentences": "SELECT count(*) AS sentences FROM enriched_sentences",
    "r_unique_titles": "SELECT count(*) AS titles FROM (SELECT DISTINCT cleaned_title FROM enriched_sentences)",
    "r_collection_stats": f"""WITH {_L}, n AS (SELECT count(*) AS n FROM l),
        s AS (SELECT source, count(*) AS c FROM l GROUP BY source ORDER BY c DESC, source NULLS FIRST LIMIT 5)
        SELECT 'total' AS kind, NULL AS name, n AS count, 100.0::DOUBLE AS percent FROM n
        UNION ALL SELECT 'label', sentiment_label, count(*), count(*) * 100.0::DOUBLE / any_value(n) FROM l, n GROUP BY sentiment_label
        UNION ALL SELECT 'source', source, c, c * 100.0::DOUBLE / n FROM s, n""",
    "r_monthly_distribution": f"""WITH {_L} SELECT year({_MOMENT})::INTEGER AS year, month({_MOMENT})::INTEGER AS month, sentiment_label, count(*) AS count FROM l
        WHERE {_MOMENT} BETWEEN TIMESTAMP '2024-01-15 00:00:00' AND TIMESTAMP '2024-06-15 23:59:59' GROUP BY ALL""",
    "r_sentiment_distribution": f"WITH {_L} SELECT sentiment_label, count(*) AS count, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percent FROM l GROUP BY sentiment_label",
    "r_top_sources": "SELECT source, count(*) AS count, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percent FROM enriched_sentences GROUP BY source ORDER BY count DESC, source NULLS FIRST LIMIT 5",
}
