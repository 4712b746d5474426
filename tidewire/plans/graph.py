"""Queries of the article graph and of data quality, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewire.operators import graph as G
from tidewire.operators import quality as Q
from tidewire.tables import table



def _s(of):
    return lambda spark, sf: of(table(spark, sf, "enriched_sentences"))


def _pairs(a, b, left, right, count="count"):
    return _s(lambda s: G.pairs(G.EDGES[a](s), G.EDGES[b](s), left, right, count))


def _degree(kind, name, count, n=None):
    return _s(lambda s: G.degree(G.EDGES[kind](s), name, count, n))


def _tpch_co_mentions(spark, sf):
    """Orders as posts, customers as people, suppliers as organisations: a large two-edge pattern."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    people = orders.select(F.col("o_orderkey").alias("url"), F.col("o_custkey").alias("name"))
    firms = lines.select(F.col("l_orderkey").alias("url"), F.col("l_suppkey").alias("name")).distinct()
    return G.pairs(people, firms, "customer", "supplier", "orders")


def _structs(spark, sf):
    """A nested bundle flattened again, in a fixed order of columns."""
    e = table(spark, sf, "extracted_entities")
    bundle = F.struct(F.col("people_mentioned").alias("people"), F.col("organizations_mentioned").alias("organizations"), F.col("locations_mentioned").alias("locations"))
    nested = e.select("entity_row_id", bundle.alias("entities")).select("entity_row_id", "entities.*")
    return Q.ordered(nested, ["entity_row_id", "people", "organizations", "locations", "no_such_column"])


def _json(spark, sf):
    """Messages as JSON text and back; what is no JSON gives nulls."""
    schema = StructType([StructField(c, StringType()) for c in ("title", "url", "publishedAt", "source_name")])
    m = table(spark, sf, "kafka_schema")
    body = F.when(F.col("msg_id") % 10 == 0, F.lit("{bad")).otherwise(F.to_json(F.struct("title", "url", "publishedAt", "source_name")))
    return m.select("msg_id", F.from_json(body, schema).alias("data")).select("msg_id", "data.*")


def _summary(spark, sf):
    m = table(spark, sf, "kafka_schema")
    return m.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(m.columns)).alias("columns"), F.min("kafka_ts").alias("first"), F.max("kafka_ts").alias("last"))


def _mentions_of_runs(spark, sf):
    """Edges of the extraction runs, a table of their own, against posts and nodes of the stored sentences: runs know
    articles and names that no sentence has."""
    stored = table(spark, sf, "enriched_sentences")
    known = G.edges(stored)
    runs = table(spark, sf, "extracted_entities")
    parts = [G.mention_edges(runs, kind).select(F.lit(kind).alias("type"), "url", "name") for kind in G.MENTIONS]
    return G.broken(parts[0].unionByName(parts[1]).unionByName(parts[2]), G.posts(stored), G.nodes(known))


def _unique_nodes(spark, sf):
    stored = table(spark, sf, "enriched_sentences")
    runs = table(spark, sf, "extracted_entities").filter("url IS NOT NULL")
    checks = [G.repeated_keys(G.posts(stored), "post", "url"), G.repeated_keys(G.source_nodes(stored), "source", "domain"), G.repeated_keys(G.nodes(G.edges(stored)), "node", "type", "name"), G.repeated_keys(runs, "run", "url")]
    return checks[0].unionByName(checks[1]).unionByName(checks[2]).unionByName(checks[3])


def _props(spark, sf):
    """The JSON property bag of events, parsed by a fixed schema; what is no JSON counts as null."""
    key = F.from_json("props", StructType([StructField("k", LongType())]))["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(key).alias("parsed"), F.count_distinct(key).alias("keys"), F.sum(key).alias("sum_of_keys"))


def _events(spark, sf):
    """Events, users and cents of each type."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


#: The stored columns of an enriched sentence, in order.
STORED = (
    "publishedAt url cleaned_title cleaned_description source source_domain category word_count people_mentioned organizations_mentioned "
    "locations_mentioned project_names financial_figures dates_mentioned topic_label sentence Sentiment_Result"
).split()

QUERIES = {
    "project_ordered": _s(lambda s: Q.ordered(s, ["sentence_id", *STORED, "no_such_column"])),
    "article_class": _s(lambda s: G.article_sentiment(s).groupBy("sentiment").agg(F.count(F.lit(1)).alias("articles"))),
    "source_short_name": _s(lambda s: G.source_nodes(s.withColumn("source", F.lit("Other")))),
    "scan_parquet": lambda spark, sf: table(spark, sf, "kafka_schema").select("msg_id", "batch_id", "source_name"),
    "load_summary": _summary,
    "struct_flatten": _structs,
    "json_parse": _json,
    "events_by_type": _events,
    "events_props": _props,
    "edge_broken": _mentions_of_runs,
    "node_uniqueness": _unique_nodes,
    "quality_metrics": lambda spark, sf: Q.metrics(table(spark, sf, "kafka_schema"), ["url", "content", "title", "publishedAt", "no_such_column"]),
    "quality_cleaned": lambda spark, sf: Q.cleaned(table(spark, sf, "kafka_schema")).select("msg_id", "url"),
    "dup_sentences": lambda spark, sf: Q.repeats(table(spark, sf, "enriched_sentences"), "sentence"),
    "dup_sentences_top": lambda spark, sf: Q.repeated(table(spark, sf, "enriched_sentences"), "sentence"),
    "dedup_sentences": lambda spark, sf: Q.first_rows(table(spark, sf, "enriched_sentences"), "sentence", "sentence_id").select("sentence_id", "sentence"),
    "join_inner_merge": lambda spark, sf: Q.merge_content(table(spark, sf, "kafka_schema"), table(spark, sf, "pipeline_task1")),
    "top_per_group": lambda spark, sf: Q.top_per_group(table(spark, sf, "kafka_schema").select("batch_id", "msg_id"), "batch_id", "msg_id", 2),
    "article_sentiment": _s(G.article_sentiment),
    "sentence_article_sentiment": _s(lambda s: G.with_article_sentiment(s).select("sentence_id", "article_sentiment")),
    "g_posts": _s(G.posts),
    "g_source_nodes": _s(G.source_nodes),
    **{f"g_edges_{kind}": _s(of) for kind, of in G.EDGES.items()},
    "edge_integrity": _s(lambda s: G.dangling(G.edges(s), G.posts(s)).agg(F.count(F.lit(1)).alias("dangling"))),
    "g_edge_counts": _s(lambda s: G.edges(s).groupBy("type").agg(F.count(F.lit(1)).alias("edges"))),
    "g_post_count_by_sentiment": _degree("sentiment", "sentiment", "posts"),
    "g_top_people": _degree("person", "person", "mentions", 15),
    "g_top_sources": _degree("source", "source", "posts", 10),
    "g_daily_post_count": _degree("date", "date", "posts"),
    "g_top_categories": _degree("category", "category", "post_count", 10),
    "g_top_locations": _degree("location", "location", "mentions", 10),
    "g_posts_by_source": _degree("source", "source", "posts"),
    "g_sentiment_by_category": _pairs("category", "sentiment", "category", "sentiment"),
    "g_co_mentions": _pairs("person", "org", "person", "organization", "co_mentions"),
    "g_categories_by_sentiment": _pairs("sentiment", "category", "sentiment", "category"),
    "g_sources_by_org": _pairs("org", "source", "organization", "source_domain", "mentions"),
    "g_daily_sentiment": _pairs("date", "sentiment", "date", "sentiment"),
    "g_co_mentions_tpch": _tpch_co_mentions,
}

_E = "enriched_sentences"
_MEAN = f"SELECT url, avg(Sentiment_Result) AS article_sentiment FROM {_E} WHERE url IS NOT NULL GROUP BY url"
_CLASS = "CASE WHEN article_sentiment IS NULL THEN 'Unknown' WHEN article_sentiment > 0.1 THEN 'Positive' WHEN article_sentiment < -0.1 THEN 'Negative' ELSE 'Neutral' END"


def _mention(c: str) -> str:
    return f"SELECT DISTINCT url, trim(n) AS name FROM (SELECT url, unnest({c}) AS n FROM {_E} WHERE url IS NOT NULL) WHERE trim(n) <> ''"


def _value(v: str) -> str:
    return f"SELECT DISTINCT url, {v} AS name FROM {_E} WHERE url IS NOT NULL AND {v} <> ''"


_EDGE = {
    "person": _mention("people_mentioned"), "org": _mention("organizations_mentioned"), "location": _mention("locations_mentioned"),
    "category": _value("trim(category)"), "sentiment": f"SELECT url, {_CLASS} AS name FROM ({_MEAN})",
    "date": _value("split_part(trim(publishedAt), 'T', 1)"), "source": _value("trim(source_domain)"),
}


def _deg(kind: str, name: str, count: str, n: int | None = None) -> str:
    return f"SELECT name AS {name}, count(*) AS {count} FROM ({_EDGE[kind]}) GROUP BY name" + (f" ORDER BY 2 DESC, 1 LIMIT {n}" if n else "")


def _two(a: str, b: str, left: str, right: str, count: str = "count") -> str:
    return f"SELECT x.name AS {left}, y.name AS {right}, count(*) AS {count} FROM ({_EDGE[a]}) x JOIN ({_EDGE[b]}) y USING (url) GROUP BY ALL"


SQL = {
    "project_ordered": f"SELECT sentence_id, {', '.join(STORED)} FROM {_E}",
    "article_class": f"SELECT {_CLASS} AS sentiment, count(*) AS articles FROM ({_MEAN}) GROUP BY 1",
    "source_short_name": f"SELECT DISTINCT trim(source_domain) AS domain, split_part(replace(trim(source_domain), 'www.', ''), '.', 1) AS name FROM {_E} WHERE trim(source_domain) <> ''",
    "scan_parquet": "SELECT msg_id, batch_id, source_name FROM kafka_schema",
    "load_summary": "SELECT count(*) AS rows, 11 AS columns, min(kafka_ts) AS first, max(kafka_ts) AS last FROM kafka_schema",
    "struct_flatten": "SELECT entity_row_id, people_mentioned AS people, organizations_mentioned AS organizations, locations_mentioned AS locations FROM extracted_entities",
    "json_parse": "SELECT msg_id, " + ", ".join(f"CASE WHEN msg_id % 10 <> 0 THEN {c} END AS {c}" for c in ("title", "url", "publishedAt", "source_name")) + " FROM kafka_schema",
    "events_by_type": "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY event_type",
    "events_props": "SELECT event_type, count(k) AS parsed, count(DISTINCT k) AS keys, sum(k)::BIGINT AS sum_of_keys FROM (SELECT event_type, (props->>'k')::BIGINT AS k FROM events) GROUP BY event_type",
    "edge_broken": "WITH e AS (" + " UNION ALL ".join(f"SELECT '{k}' AS type, url, name FROM ({_EDGE[k].replace(_E, 'extracted_entities')})" for k in ("person", "org", "location"))
    + "), n AS (" + " UNION ".join(f"SELECT '{k}' AS type, name FROM ({_EDGE[k]})" for k in ("person", "org", "location"))
    + f"""), p AS (SELECT DISTINCT url AS post FROM {_E} WHERE url IS NOT NULL)
        SELECT e.type, count(*) AS edges, count(*) FILTER (post IS NULL) AS no_post, count(*) FILTER (n.name IS NULL) AS no_node FROM e LEFT JOIN p ON post = url LEFT JOIN n ON n.type = e.type AND n.name = e.name GROUP BY e.type""",
    "node_uniqueness": f"""SELECT 'post' AS label, count(DISTINCT url) AS nodes, 0::BIGINT AS repeated FROM {_E} UNION ALL SELECT 'source', count(DISTINCT trim(source_domain)), 0 FROM {_E} WHERE trim(source_domain) <> ''
        UNION ALL SELECT 'node', count(*), 0 FROM (""" + " UNION ".join(f"SELECT '{k}' AS type, name FROM ({v})" for k, v in _EDGE.items())
    + """) UNION ALL SELECT 'run', sum(n)::BIGINT, (sum(n) FILTER (n > 1))::BIGINT FROM (SELECT count(*) AS n FROM extracted_entities WHERE url IS NOT NULL GROUP BY url)""",
    "quality_metrics": "SELECT count(*) AS rows, " + ", ".join(f"count(*) FILTER ({c} IS NULL OR {c} = '') AS empty_{c}" for c in ("url", "content", "title", "publishedAt"))
    + ", count(*) FILTER (NOT regexp_matches(url, '^https?://.+')) AS invalid_urls, count(DISTINCT url) AS distinct_urls, count(url) - count(DISTINCT url) AS repeated_urls, count(*) FILTER (length(content) < 20) AS short_texts FROM kafka_schema",
    "quality_cleaned": "SELECT msg_id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY msg_id) AS k FROM kafka_schema WHERE regexp_matches(url, '^https?://.+')) WHERE k = 1 AND length(content) >= 20",
    "dup_sentences": f'SELECT count(DISTINCT sentence) AS "distinct", count(sentence) - count(DISTINCT sentence) AS repeated FROM {_E}',
    "dup_sentences_top": f"SELECT sentence, count(*) AS count FROM {_E} WHERE sentence IS NOT NULL GROUP BY sentence HAVING count(*) > 1 ORDER BY count DESC, sentence LIMIT 5",
    "dedup_sentences": f"SELECT sentence_id, sentence FROM (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY sentence_id) AS k FROM {_E}) WHERE k = 1",
    "join_inner_merge": """WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY msg_id DESC) AS k FROM kafka_schema WHERE url <> '') WHERE k = 1),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY record_id DESC) AS k FROM pipeline_task1 WHERE url <> '') WHERE k = 1)
        SELECT a.url, a.title, a.publishedAt, a.source_name, b.content AS page_content FROM a JOIN b ON a.url = b.url WHERE b.content <> ''""",
    "top_per_group": "SELECT * FROM (SELECT batch_id, msg_id, row_number() OVER (PARTITION BY batch_id ORDER BY msg_id)::INTEGER AS rank FROM kafka_schema) WHERE rank <= 2",
    "article_sentiment": f"SELECT url, article_sentiment, {_CLASS} AS sentiment FROM ({_MEAN})",
    "sentence_article_sentiment": f"SELECT sentence_id, m.article_sentiment FROM {_E} e LEFT JOIN ({_MEAN}) m USING (url)",
    "g_posts": f"""SELECT url, coalesce(arg_min_null(publishedAt, sentence_id), '') AS publishedAt, coalesce(arg_min_null(cleaned_title, sentence_id), '') AS cleaned_title,
        coalesce(arg_min_null(cleaned_description, sentence_id), '') AS cleaned_description, coalesce(arg_min_null(word_count, sentence_id), 0) AS word_count,
        avg(Sentiment_Result) AS sentiment, 'post_' || sha256(url) AS post_id FROM {_E} WHERE url IS NOT NULL GROUP BY url""",
    "g_source_nodes": f"SELECT trim(source_domain) AS domain, max(CASE WHEN source = 'Other' THEN split_part(replace(trim(source_domain), 'www.', ''), '.', 1) ELSE trim(source) END) AS name FROM {_E} WHERE trim(source_domain) <> '' GROUP BY 1",
    **{f"g_edges_{kind}": sql for kind, sql in _EDGE.items()},
    "edge_integrity": "SELECT count(*) AS dangling FROM (" + " UNION ALL ".join(f"SELECT url FROM ({v})" for v in _EDGE.values()) + f") WHERE url NOT IN (SELECT url FROM {_E} WHERE url IS NOT NULL)",
    "g_edge_counts": "SELECT type, count(*) AS edges FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS type, url, name FROM ({v})" for k, v in _EDGE.items()) + ") GROUP BY type",
    "g_post_count_by_sentiment": _deg("sentiment", "sentiment", "posts"),
    "g_top_people": _deg("person", "person", "mentions", 15),
    "g_top_sources": _deg("source", "source", "posts", 10),
    "g_daily_post_count": _deg("date", "date", "posts"),
    "g_top_categories": _deg("category", "category", "post_count", 10),
    "g_top_locations": _deg("location", "location", "mentions", 10),
    "g_posts_by_source": _deg("source", "source", "posts"),
    "g_sentiment_by_category": _two("category", "sentiment", "category", "sentiment"),
    "g_co_mentions": _two("person", "org", "person", "organization", "co_mentions"),
    "g_categories_by_sentiment": _two("sentiment", "category", "sentiment", "category"),
    "g_sources_by_org": _two("org", "source", "organization", "source_domain", "mentions"),
    "g_daily_sentiment": _two("date", "sentiment", "date", "sentiment"),
    "g_co_mentions_tpch": "SELECT o_custkey AS customer, l_suppkey AS supplier, count(*) AS orders FROM orders JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON o_orderkey = l_orderkey GROUP BY ALL",
}
