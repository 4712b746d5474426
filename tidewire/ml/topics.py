"""Topics of articles by latent Dirichlet allocation."""

from __future__ import annotations

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, StopWordsRemover, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.wordlists import TOPIC_STOP_WORDS
from tidewire.session import cut


def topics(articles: DataFrame, key: str, text: str, k: int = 5, iterations: int = 15, vocabulary: int = 5_000, least_documents: float = 5.0, seed: int = 42) -> DataFrame:
    """(key, dominant_topic, topic_label): the first of the most likely topics and its up to three leading words.

    Words of two letters and stop words don't name a topic; one without words left is 'Unknown Topic'. Null texts count
    as empty and have topic 0.
    """
    rows = articles.select(key, F.coalesce(text, F.lit("")).alias("_text"))
    words = Tokenizer(inputCol="_text", outputCol="_words").transform(rows)
    stop = StopWordsRemover.loadDefaultStopWords("english") + TOPIC_STOP_WORDS
    kept = StopWordsRemover(inputCol="_words", outputCol="_kept", stopWords=stop).transform(words)
    counter = CountVectorizer(inputCol="_kept", outputCol="features", vocabSize=vocabulary, minDF=least_documents).fit(kept)
    counted = cut(counter.transform(kept).select(key, "features"))
    model = LDA(k=k, maxIter=iterations, seed=seed).fit(counted)
    stops = set(stop)
    named = []
    for r in model.describeTopics(5).collect():  # k rows
        leading = [w for w in (counter.vocabulary[i] for i in r.termIndices) if len(w) > 2 and w not in stops][:3]
        named.append((r.topic, ", ".join(leading) or "Unknown Topic"))
    shares = vector_to_array("topicDistribution")
    found = model.transform(counted).select(key, (F.array_position(shares, F.array_max(shares)) - 1).cast("int").alias("dominant_topic"))
    labels = articles.sparkSession.createDataFrame(named, "dominant_topic int, topic_label string")
    return found.join(F.broadcast(labels), "dominant_topic", "left").select(key, "dominant_topic", "topic_label")


def with_topics(articles: DataFrame, found: DataFrame, labels: DataFrame, key: str = "url") -> DataFrame:
    """``articles`` with ``dominant_topic`` and ``topic_label``, joined back on ``key``.

    ``found`` has (key, dominant_topic), one row a key; ``labels`` has (dominant_topic, topic_label), a row for each topic
    of a model. A topic without a label is 'Unknown Topic n', an article without a topic 'N/A'.
    """
    named = found.select(key, "dominant_topic").join(labels.select("dominant_topic", "topic_label"), "dominant_topic", "left")
    label = F.coalesce("topic_label", F.concat(F.lit("Unknown Topic "), "dominant_topic"), F.lit("N/A"))
    return articles.drop("dominant_topic", "topic_label").join(named, key, "left").withColumn("topic_label", label)


def without_topics(articles: DataFrame) -> DataFrame:
    """``articles`` with empty topic columns where there are none, as when no model could be fitted."""
    for column, value in (("dominant_topic", F.lit(None).cast("int")), ("topic_label", F.lit("N/A"))):
        if column not in articles.columns:
            articles = articles.withColumn(column, value)
    return articles
