"""Reports over scored sentences: filter, group, aggregate, order.

Lists of a group's sentences come as rows of ``sentences_of``, never as one array, so that a title with a third of all
sentences stays many rows. Ties in an order are broken by the group's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.enrich import sentiment_label

LABELS = ("positive", "neutral", "negative")


def labelled(sentences: DataFrame) -> DataFrame:
    """``sentences`` with ``sentiment_label`` of the score; a null score is negative, as the stored documents have it."""
    return sentences.withColumn("sentiment_label", sentiment_label(F.col("Sentiment_Result")))


def _n(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def label_counts() -> list[Column]:
    return [_n(F.col("sentiment_label") == x, f"{x}_count") for x in LABELS]


def shares(df: DataFrame, total: str) -> DataFrame:
    """Each label's count in percent of ``total``; 0 of nothing."""
    percent = lambda x: F.when(F.col(total) > 0, F.col(f"{x}_count") * 100.0 / F.col(total)).otherwise(0.0)
    return df.withColumns({f"{x}_percent": percent(x) for x in LABELS})


def strong_by_title(sentences: DataFrame, label: str) -> DataFrame:
    """Titles by their sentences of one label: count, mean score, and the counts of each strength."""
    sign = 1 if label == "positive" else -1
    score = F.col("Sentiment_Result")
    rows = labelled(sentences).filter((F.col("sentiment_label") == label) & (score * sign > 0))
    return rows.groupBy("cleaned_title").agg(
        F.count(F.lit(1)).alias("sentences"), F.avg(score).alias("average_sentiment"),
        _n(score == sign, "weak_count"), _n(score == 2 * sign, "strong_count"),
    ).orderBy(F.desc("sentences"), "cleaned_title")


def sentences_of(sentences: DataFrame, label: str) -> DataFrame:
    """The sentences behind ``strong_by_title``, one a row."""
    sign = 1 if label == "positive" else -1
    rows = labelled(sentences).filter((F.col("sentiment_label") == label) & (F.col("Sentiment_Result") * sign > 0))
    return rows.select("sentence_id", "cleaned_title", "sentence", "Sentiment_Result")


def with_location(sentences: DataFrame, first: str, second: str, n: int) -> DataFrame:
    """The latest ``n`` neutral or positive sentences that mention one of two places."""
    rows = labelled(sentences).filter(F.col("sentiment_label").isin("neutral", "positive"))
    rows = rows.filter(F.arrays_overlap("locations_mentioned", F.array(F.lit(first), F.lit(second))))
    latest = rows.orderBy(F.desc("publishedAt"), "sentence_id").limit(n)
    return latest.select("sentence_id", F.col("cleaned_title").alias("title"), "cleaned_description", "publishedAt", "sentiment_label", "sentence")


def top_categories(sentences: DataFrame, label: str, n: int) -> DataFrame:
    rows = labelled(sentences).filter(F.col("sentiment_label") == label)
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "category").limit(n)


def by_published(sentences: DataFrame, n: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """The latest ``n`` articles (title and description): labels, sources and categories as sets, count and mean score.

    Dates compare as text, and only if both bounds are given.
    """
    rows = labelled(sentences)
    if start and end:
        rows = rows.filter(F.col("publishedAt").between(start, end))
    first = lambda c: F.min_by(c, "sentence_id").alias(c)
    sets = [F.array_sort(F.collect_set(c)).alias(name) for c, name in (("sentiment_label", "labels"), ("source", "sources"), ("category", "categories"))]
    grouped = rows.groupBy("cleaned_title", "cleaned_description").agg(
        *sets, first("publishedAt"), first("url"), F.count(F.lit(1)).alias("sentences"), F.avg("Sentiment_Result").alias("average_sentiment")
    )
    return grouped.orderBy(F.desc("publishedAt"), "cleaned_title", "cleaned_description").limit(n)


def mixed(sentences: DataFrame) -> DataFrame:
    """Titles with more than one label: counts and percentages, and how many sources and addresses."""
    rows = labelled(sentences).groupBy("cleaned_title").agg(
        F.count(F.lit(1)).alias("sentences"), *label_counts(), F.array_sort(F.collect_set("source")).alias("sources"),
        F.count_distinct("url").alias("urls"), F.min_by("publishedAt", "sentence_id").alias("publishedAt"),
    )
    several = sum(F.when(F.col(f"{x}_count") > 0, 1).otherwise(0) for x in LABELS) > 1
    return shares(rows.filter(several), "sentences").orderBy(F.desc("sentences"), "cleaned_title")


def top_titles(sentences: DataFrame, condition: Column, name: str, n: int = 10) -> DataFrame:
    rows = labelled(sentences).filter(condition)
    return rows.groupBy("cleaned_title").agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), "cleaned_title").limit(n)


def _pattern(words: list[str], literal: bool) -> str:
    """An alternation in any case; ``literal`` takes the words as they are, else they are patterns."""
    quoted = ["".join(c if c.isalnum() or c == " " else f"\\{c}" for c in w) for w in words] if literal else words
    return "(?i)" + "|".join(quoted)


def keyword_search(sentences: DataFrame, keyword: str, literal: bool = False) -> DataFrame:
    """Titles whose title or description matches: label counts, labels and sources."""
    p = _pattern([keyword], literal)
    rows = labelled(sentences).filter(F.col("cleaned_title").rlike(p) | F.col("cleaned_description").rlike(p))
    return rows.groupBy("cleaned_title").agg(
        *label_counts(), F.array_sort(F.collect_set("sentiment_label")).alias("labels"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.count_distinct("url").alias("urls"),
    ).orderBy(F.desc("positive_count"), "cleaned_title")


def keyword_sentences(sentences: DataFrame, keywords: list[str], n: int = 10, start: str | None = None, end: str | None = None, literal: bool = False) -> DataFrame:
    """The latest ``n`` titles with sentences that match one of ``keywords``, and how many."""
    rows = labelled(sentences).filter(F.col("sentence").rlike(_pattern(keywords, literal)))
    if start and end:
        rows = rows.filter(F.col("publishedAt").between(start, end))
    first = [F.min_by(c, "sentence_id").alias(c) for c in ("sentiment_label", "publishedAt", "source", "url")]
    return rows.groupBy("cleaned_title").agg(F.count(F.lit(1)).alias("sentences"), *first).orderBy(F.desc("publishedAt"), "cleaned_title").limit(n)


def keyword_rows(sentences: DataFrame, keywords: list[str], start: str | None = None, end: str | None = None, literal: bool = False) -> DataFrame:
    """The sentences behind ``keyword_sentences``, one a row."""
    rows = labelled(sentences).filter(F.col("sentence").rlike(_pattern(keywords, literal)))
    if start and end:
        rows = rows.filter(F.col("publishedAt").between(start, end))
    return rows.select("sentence_id", "cleaned_title", "sentence", "sentiment_label")


def keyword_urls(sentences: DataFrame, keyword: str, literal: bool = False) -> DataFrame:
    """The different addresses behind ``keyword_search``, one a row."""
    p = _pattern([keyword], literal)
    rows = sentences.filter(F.col("cleaned_title").rlike(p) | F.col("cleaned_description").rlike(p))
    return rows.filter(F.col("url").isNotNull()).select("cleaned_title", "url").distinct()


def daily(sentences: DataFrame) -> DataFrame:
    """By day and title: sentences, mean score, and the labels in number and percent."""
    rows = labelled(sentences).groupBy(F.substring("publishedAt", 1, 10).alias("day"), F.col("cleaned_title").alias("title"))
    counted = rows.agg(F.count(F.lit(1)).alias("sentences"), F.avg("Sentiment_Result").alias("average_sentiment"), *label_counts())
    return shares(counted, "sentences").orderBy("day", "title")


def source_summary(sentences: DataFrame) -> DataFrame:
    """By source: titles, sentences, mean score, labels, and the most common category (the least name of equals)."""
    rows = labelled(sentences)
    counted = rows.groupBy("source").agg(
        (F.count_distinct("cleaned_title") + F.max(F.when(F.col("cleaned_title").isNull(), 1).otherwise(0))).alias("articles"),
        F.count(F.lit(1)).alias("sentences"), F.avg("Sentiment_Result").alias("average_sentiment"), *label_counts(),
    )
    per_category = rows.groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("source").orderBy(F.desc("n"), F.col("category").asc_nulls_last())
    top = per_category.withColumn("k", F.row_number().over(order)).filter("k = 1")
    top = top.select(F.col("source").alias("_source"), F.col("category").alias("top_category"), F.col("n").alias("top_category_sentences"))
    joined = shares(counted, "sentences").join(top, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return joined.orderBy(F.desc("average_sentiment"), "source")


def monthly(sentences: DataFrame, start: str, end: str) -> DataFrame:
    """By year, month and label within inclusive times; texts that are no such time drop out."""
    at = F.try_to_timestamp("publishedAt", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    bound = lambda s: F.to_timestamp(F.lit(s), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = labelled(sentences).withColumn("_at", at).filter(F.col("_at").between(bound(start), bound(end)))
    keys = [F.year("_at").alias("year"), F.month("_at").alias("month"), "sentiment_label"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).orderBy("year", "month", "sentiment_label")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows by value of ``column`` and their share of all in percent. The total is a scalar subquery over the grouped
    counts, so no window brings all values into one task."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = counted.agg(F.sum("count")).scalar()
    return counted.withColumn("percent", F.col("count") * 100.0 / total).orderBy(F.desc("count"), column)


def top_share(df: DataFrame, column: str, n: int) -> DataFrame:
    return distribution(df, column).limit(n)


def totals(sentences: DataFrame) -> DataFrame:
    """Sentences and different titles; sentences without a title count as one title."""
    untitled = F.max(F.when(F.col("cleaned_title").isNull(), 1).otherwise(0))
    return sentences.agg(F.count(F.lit(1)).alias("sentences"), (F.count_distinct("cleaned_title") + F.coalesce(untitled, F.lit(0))).alias("titles"))


def collection_stats(sentences: DataFrame, n: int = 5) -> DataFrame:
    """(kind, name, count, percent): all sentences, each label, and the ``n`` most frequent sources."""
    rows = labelled(sentences)
    total = rows.agg(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("name"), F.count(F.lit(1)).alias("count"), F.lit(100.0).alias("percent"))
    named = lambda df, kind, column: df.select(F.lit(kind).alias("kind"), F.col(column).alias("name"), "count", "percent")
    labels = named(distribution(rows, "sentiment_label"), "label", "sentiment_label")
    return total.unionByName(labels).unionByName(named(top_share(rows, "source", n), "source", "source"))
