"""Queries of the streaming, HTML, language and model operators, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import language
from tidewire.functions.html import VOID, extract_pages, readable
from tidewire.ml import sentiment, topics
from tidewire.functions import enrich as E
from tidewire.plans.columns import _AUTHORITY, _CLEAN, _Q, _UNIQUE, _cases
from tidewire.functions import wordlists as L
from tidewire.streaming import pipeline as P
from tidewire.tables import table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return P.event_time(table(spark, sf, "kafka_schema"))


def stream_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming transformation over the whole table; tests run the same one as a stream and compare."""
    return P.sentences(table(spark, sf, "kafka_schema")).select("msg_id", "source", "source_domain", "category", "sentence")


def _html(spark: SparkSession, sf: str) -> DataFrame:
    """(url, html): pages wrapped as HTML, one paragraph per line, furniture in dropped tags; the id stands for the url."""
    clean = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    title = F.concat(F.lit("<html><head><title>"), clean(F.coalesce("title", F.lit(""))), F.lit("</title></head><body><nav>Home</nav>"))
    body = F.concat_ws("", F.transform(F.split("content", "\n"), lambda line: F.concat(F.lit("<p>"), clean(line), F.lit("</p>"))))
    html = F.concat(title, F.coalesce(body, F.lit("")), F.lit("<footer><p>End</p></footer></body></html>"))
    return table(spark, sf, "pipeline_task1").select(F.col("record_id").cast("string").alias("url"), html.alias("html"))


def http_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that hold a page. Status and type stand for what a fetch of each page met: nothing found where the content is
    missing, an error of the server where it is empty, another type where there is no title."""
    status = F.when(F.col("content").isNull(), 404).when(F.col("content") == "", 503).otherwise(200)
    kind = F.when(F.col("title").isNull(), "application/pdf").otherwise("Text/HTML; charset=UTF-8")
    fetched = table(spark, sf, "pipeline_task1").select("record_id", status.alias("status"), kind.alias("content_type"))
    return readable(fetched).select("record_id")


HIDDEN = "hidden block"


def html_families(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's lines as paragraphs among one block of every tag and class that isn't part of an article: how many
    paragraphs come out and how many of them hold text of such a block."""
    text = f"<p>{HIDDEN}</p>"
    blocks = [f"<{t}>{text}</{t}>" for t in [*L.HTML_TAGS, *L.HTML_TEXTLESS] if t not in VOID]
    blocks += [f'<{t} class="x {c}">{text}</{t}>' for t in ("div", "section", "span") for c in L.HTML_CLASSES] + [f'<div class="{c}">{text}</div>' for c in L.HTML_DIV_CLASSES]
    pages = _html(spark, sf).withColumn("html", F.replace("html", F.lit("</nav>"), F.lit("</nav>" + "".join(blocks))))
    found = extract_pages(pages)
    hidden = F.size(F.filter("paragraphs", lambda p: p.contains(HIDDEN)))
    return found.select(F.col("url").cast("bigint").alias("record_id"), F.size("paragraphs").alias("paragraphs"), hidden.alias("hidden"))


def topic_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Topics joined back on url: a number per url stands for a model's topic, the subject areas for the labels of the
    first ten of twelve."""
    sentences = table(spark, sf, "enriched_sentences")
    found = sentences.filter("url IS NOT NULL").groupBy("url").agg((F.min("word_count") % 12).alias("dominant_topic"))
    names = table(spark, sf, "subject_areas").agg(F.array_sort(F.collect_list("subject")).alias("names"))
    labels = names.select(F.posexplode("names").alias("dominant_topic", "topic_label"))
    return topics.with_topics(sentences, found, labels).select("sentence_id", "dominant_topic", "topic_label")


def html_title(spark: SparkSession, sf: str) -> DataFrame:
    """Page titles by a native expression, where nothing else of the page is needed."""
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return _html(spark, sf).select(F.col("url").cast("bigint").alias("record_id"), F.when(title != "", title).otherwise("No Title Found").alias("title"))


def html_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The wrapped pages taken apart again."""
    found = extract_pages(_html(spark, sf))
    return found.select(F.col("url").cast("bigint").alias("record_id"), "title", F.size("paragraphs").alias("paragraphs"))


def lang_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter(language.is_english(F.col("text"))).select("doc_id")


def lang_detect(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", language.language(F.col("text")).alias("language"))


def ml_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences scored by a model trained on the scored ones."""
    sentences = table(spark, sf, "enriched_sentences")
    model, _, _ = sentiment.train(sentiment.training_rows(sentences))
    return sentiment.score(model, sentences.select("sentence_id", "sentence"))


def ml_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """The model's accuracy on the rows that trained it and on those held out."""
    _, fit, held = sentiment.train(sentiment.training_rows(table(spark, sf, "enriched_sentences")))
    return spark.createDataFrame([("train", fit), ("test", held)], "part string, accuracy double")


def stream_stored(spark: SparkSession, sf: str) -> DataFrame:
    """All stored columns but the score, which needs a model; tests run the same transformation as a stream."""
    return P.sentences(table(spark, sf, "kafka_schema"))


def ml_topics(spark: SparkSession, sf: str) -> DataFrame:
    return topics.topics(table(spark, sf, "documents"), "doc_id", "text")


QUERIES = {
    "stream_sentences": stream_sentences,
    "stream_stored": stream_stored,
    "stream_tumbling": lambda spark, sf: P.tumbling(_events(spark, sf), "source_name"),
    "stream_sliding": lambda spark, sf: P.sliding(_events(spark, sf), "source_name"),
    "stream_sessions": lambda spark, sf: P.sessions(_events(spark, sf), "source_name"),
    "http_pages": http_pages,
    "html_title": html_title,
    "html_extract": html_extract,
    "html_families": html_families,
    "topic_labels": topic_labels,
    "lang_filter": lang_filter,
    "lang_detect": lang_detect,
    "ml_sentiment": ml_sentiment,
    "ml_accuracy": ml_accuracy,
    "ml_topics": ml_topics,
}

_TIMED = r"""t AS (SELECT msg_id, source_name, try_cast(CASE WHEN regexp_matches(publishedAt, '(Z|[+-]\d{2}:\d{2})$') THEN publishedAt ELSE publishedAt || 'Z' END AS TIMESTAMPTZ) AS moment
  FROM kafka_schema WHERE regexp_matches(publishedAt, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$')),
  e AS (SELECT msg_id, source_name, moment FROM t WHERE moment IS NOT NULL)"""
_OUTLET = "CASE " + " ".join(f"WHEN contains(url, '{p}') THEN '{v}'" for p, v in L.OUTLETS) + " ELSE 'Other' END"
_SHARES = ", ".join(f"len(list_filter(w, lambda x: list_contains([{', '.join(repr(x) for x in ws.split())}], x)))::DOUBLE / len(w) AS {k}" for k, ws in language.WORDS.items())
_LANGUAGE = f"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}'']+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, {_SHARES} FROM w WHERE len(w) > 0),
        l AS (SELECT doc_id, CASE WHEN greatest({', '.join(language.WORDS)}) < {language.LEAST} THEN NULL """ + " ".join(f"WHEN {k} = greatest({', '.join(language.WORDS)}) THEN '{k}'" for k in language.WORDS) + """ END AS language, en FROM s)"""

SQL = {
    "stream_sentences": f"""WITH c AS (SELECT msg_id, url, {_CLEAN} AS cleaned FROM kafka_schema WHERE title IS NOT NULL AND content IS NOT NULL),
        s AS (SELECT *, trim(unnest(string_split(regexp_replace(cleaned, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)))) AS sentence FROM c)
        SELECT msg_id, {_OUTLET} AS source, CASE WHEN regexp_matches(url, '^https?://.+') THEN {_AUTHORITY} END AS source_domain, {_cases('cleaned', L.CATEGORIES, "'General'")} AS category, sentence
        FROM s WHERE length(sentence) > 10""",
    "stream_tumbling": f"WITH {_TIMED} SELECT date_trunc('day', moment) AS start, date_trunc('day', moment) + INTERVAL 1 DAY AS \"end\", source_name, count(*) AS n FROM e GROUP BY ALL",
    "stream_sliding": f"""WITH {_TIMED}, w AS (SELECT source_name, date_trunc('day', moment) - to_days(unnest([0, 1])) AS start FROM e)
        SELECT start, start + INTERVAL 2 DAY AS "end", source_name, count(*) AS n FROM w GROUP BY ALL""",
    "stream_sessions": f"""WITH {_TIMED}, g AS (SELECT *, CASE WHEN moment - lag(moment) OVER (PARTITION BY source_name ORDER BY moment, msg_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM e),
        n AS (SELECT *, sum(fresh) OVER (PARTITION BY source_name ORDER BY moment, msg_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT min(moment) AS start, max(moment) + INTERVAL 6 HOUR AS "end", source_name, count(*) AS n FROM n GROUP BY source_name, k""",
    "stream_stored": f"""WITH c AS (SELECT *, {_CLEAN} AS cleaned FROM kafka_schema WHERE title IS NOT NULL AND content IS NOT NULL),
        e AS (SELECT msg_id, publishedAt, url, {_CLEAN.replace('coalesce(content,', 'coalesce(title,')} AS cleaned_title, {_CLEAN.replace('coalesce(content,', 'coalesce(description,')} AS cleaned_description,
          {_OUTLET} AS source, CASE WHEN regexp_matches(url, '^https?://.+') THEN {_AUTHORITY} END AS source_domain, {_cases('cleaned', L.CATEGORIES, "'General'")} AS category,
          len(regexp_split_to_array(cleaned, '\\s+'))::INTEGER AS word_count, regexp_extract_all(cleaned, '{E.ENTITY}') AS pe, regexp_extract_all(cleaned, '{_Q(E.ORGANISATION)}') AS og, regexp_extract_all(cleaned, '{_Q(E.PLACE)}', 1) AS lo,
          list_transform(regexp_extract_all(cleaned, '{_Q(E.PROJECT)}', 1), lambda x: trim(x)) AS pr, regexp_extract_all(content, '{E.MONEY}') AS fi, regexp_extract_all(cleaned, '{_Q(E.DATE)}') AS da, NULL::VARCHAR AS topic_label,
          trim(unnest(string_split(regexp_replace(cleaned, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)))) AS sentence FROM c)
        SELECT msg_id, publishedAt, url, cleaned_title, cleaned_description, source, source_domain, category, word_count, {_UNIQUE.format('pe')}[1:10] AS people_mentioned, {_UNIQUE.format('og')}[1:10] AS organizations_mentioned,
          {_UNIQUE.format('lo')}[1:10] AS locations_mentioned, {_UNIQUE.format('pr')} AS project_names, {_UNIQUE.format('fi')}[1:10] AS financial_figures, {_UNIQUE.format('da')}[1:10] AS dates_mentioned, topic_label, sentence
        FROM e WHERE length(sentence) > 10""",
    "http_pages": "SELECT record_id FROM pipeline_task1 WHERE content <> '' AND title IS NOT NULL",
    "html_families": """SELECT record_id, len(list_filter(string_split(coalesce(content, ''), chr(10)), lambda x: regexp_matches(x, '\\S')))::INTEGER AS paragraphs, 0 AS hidden FROM pipeline_task1""",
    "topic_labels": """WITH lab AS (SELECT (row_number() OVER (ORDER BY subject) - 1)::INTEGER AS topic, subject FROM subject_areas),
        t AS (SELECT url, (min(word_count) % 12)::INTEGER AS dominant_topic FROM enriched_sentences WHERE url IS NOT NULL GROUP BY url)
        SELECT sentence_id, dominant_topic, CASE WHEN dominant_topic IS NULL THEN 'N/A' ELSE coalesce(subject, 'Unknown Topic ' || dominant_topic) END AS topic_label
        FROM enriched_sentences LEFT JOIN t USING (url) LEFT JOIN lab ON topic = dominant_topic""",
    "html_title": "SELECT record_id, coalesce(nullif(trim(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')), ''), 'No Title Found') AS title FROM pipeline_task1",
    "html_extract": """SELECT record_id, coalesce(nullif(trim(title), ''), 'No Title Found') AS title,
        len(list_filter(string_split(coalesce(content, ''), chr(10)), lambda x: regexp_matches(x, '\\S')))::INTEGER AS paragraphs FROM pipeline_task1""",
    "lang_filter": f"WITH {_LANGUAGE} SELECT doc_id FROM l WHERE language = 'en' AND en >= {language.GATE}",
    "lang_detect": f"WITH {_LANGUAGE} SELECT doc_id, language FROM documents LEFT JOIN l USING (doc_id)",
}
