"""The article graph as node and edge tables, and its reports as joins over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import enrich as E

MENTIONS = {"person": "people_mentioned", "org": "organizations_mentioned", "location": "locations_mentioned"}


def with_article_sentiment(sentences: DataFrame) -> DataFrame:
    """Sentences with ``article_sentiment``, the mean score of their url; null for null urls.

    The means are combined on the map side and joined back; adaptive execution splits the rows of a hot url in the join,
    which a window over the url would sort in one task.
    """
    mean = sentences.filter(F.col("url").isNotNull()).groupBy("url").agg(F.avg("Sentiment_Result").alias("article_sentiment"))
    return sentences.join(mean, "url", "left")


def article_sentiment(sentences: DataFrame) -> DataFrame:
    """(url, mean, class) of each article. Aggregation alone, as hot urls then combine on the map side."""
    mean = sentences.filter(F.col("url").isNotNull()).groupBy("url").agg(F.avg("Sentiment_Result").alias("article_sentiment"))
    return mean.withColumn("sentiment", E.article_class(F.col("article_sentiment")))


def posts(sentences: DataFrame) -> DataFrame:
    """One node per url: the values of its first sentence, empty texts and 0 for missing ones, and the mean score."""
    first = lambda c: F.min_by(c, "sentence_id")
    text = lambda c: F.coalesce(first(c), F.lit("")).alias(c)
    rows = sentences.filter(F.col("url").isNotNull()).groupBy("url")
    return rows.agg(
        text("publishedAt"), text("cleaned_title"), text("cleaned_description"), F.coalesce(first("word_count"), F.lit(0)).alias("word_count"),
        F.avg("Sentiment_Result").alias("sentiment"),
    ).withColumn("post_id", E.post_id(F.col("url")))


def mention_edges(sentences: DataFrame, kind: str) -> DataFrame:
    """Distinct (url, name) of the people, organisations or places mentioned, trimmed and not empty."""
    pairs = sentences.filter(F.col("url").isNotNull()).select("url", F.explode(MENTIONS[kind]).alias("name"))
    return pairs.select("url", F.trim("name").alias("name")).filter(F.col("name") != "").distinct()


def _value_edges(sentences: DataFrame, value: Column) -> DataFrame:
    return sentences.filter(F.col("url").isNotNull()).select("url", value.alias("name")).filter(F.col("name") != "").distinct()


def category_edges(sentences: DataFrame) -> DataFrame:
    return _value_edges(sentences, F.trim("category"))


def date_edges(sentences: DataFrame) -> DataFrame:
    return _value_edges(sentences, E.pub_day(F.col("publishedAt")))


def sentiment_edges(sentences: DataFrame) -> DataFrame:
    return article_sentiment(sentences).select("url", F.col("sentiment").alias("name"))


def source_edges(sentences: DataFrame) -> DataFrame:
    return _value_edges(sentences, F.trim("source_domain"))


def source_nodes(sentences: DataFrame) -> DataFrame:
    """(domain, name): one node per domain; a name 'Other' becomes the short form of the domain, several names the greatest."""
    domain = F.trim("source_domain")
    name = F.when(F.col("source") == "Other", E.source_short_name(domain)).otherwise(F.trim("source"))
    return sentences.filter(domain != "").groupBy(domain.alias("domain")).agg(F.max(name).alias("name"))


EDGES = {
    "person": lambda s: mention_edges(s, "person"),
    "org": lambda s: mention_edges(s, "org"),
    "location": lambda s: mention_edges(s, "location"),
    "category": category_edges,
    "sentiment": sentiment_edges,
    "date": date_edges,
    "source": source_edges,
}


def edges(sentences: DataFrame) -> DataFrame:
    """All edges as one table (type, url, name)."""
    parts = [of(sentences).select(F.lit(kind).alias("type"), "url", "name") for kind, of in EDGES.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dangling(edge_table: DataFrame, post_table: DataFrame) -> DataFrame:
    """Edges whose post doesn't exist."""
    return edge_table.join(post_table.select("url"), "url", "left_anti")


def nodes(edge_table: DataFrame) -> DataFrame:
    """(type, name): every node that is no post, once."""
    return edge_table.select("type", "name").distinct()


def broken(edge_table: DataFrame, post_table: DataFrame, node_table: DataFrame) -> DataFrame:
    """(type, edges, no_post, no_node): the edges of each type, and how many lack a post or a node of their type."""
    posts_ = post_table.select("url", F.lit(1).alias("_post")).distinct()
    nodes_ = node_table.select("type", "name", F.lit(1).alias("_node")).distinct()
    joined = edge_table.join(posts_, "url", "left").join(nodes_, ["type", "name"], "left")
    return joined.groupBy("type").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("_post").isNull()).alias("no_post"), F.count_if(F.col("_node").isNull()).alias("no_node"))


def repeated_keys(table: DataFrame, label: str, *key: str) -> DataFrame:
    """(label, nodes, repeated): the rows of a node table and how many share their key with another."""
    per = table.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated")).select(F.lit(label).alias("label"), "nodes", "repeated")


def write_graph(sentences: DataFrame, folder: str) -> None:
    """Posts, nodes and edges as tables under ``folder``, edges parted by type. Writing again replaces them, so that a
    repeated load leaves one node for each key."""
    found = edges(sentences)
    posts(sentences).write.mode("overwrite").parquet(f"{folder}/posts")
    source_nodes(sentences).write.mode("overwrite").parquet(f"{folder}/sources")
    nodes(found).write.mode("overwrite").parquet(f"{folder}/nodes")
    found.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")


def degree(edge_table: DataFrame, name: str, count: str, n: int | None = None) -> DataFrame:
    """Posts per node, most first; ties by name."""
    out = edge_table.groupBy(F.col("name").alias(name)).agg(F.count(F.lit(1)).alias(count)).orderBy(F.desc(count), name)
    return out.limit(n) if n else out


def pairs(left: DataFrame, right: DataFrame, a: str, b: str, count: str) -> DataFrame:
    """Posts that each two nodes share: one join of two edge tables on the post, then a count.

    Both sides are distinct, so a post adds each pair once. A pair of mention tables joins small name lists of a post, not
    the rows of a key that one post repeats.
    """
    joined = left.select("url", F.col("name").alias(a)).join(right.select("url", F.col("name").alias(b)), "url")
    return joined.groupBy(a, b).agg(F.count(F.lit(1)).alias(count)).orderBy(a, F.desc(count), b)
