"""Sentiment of sentences: weighted terms and logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, StopWordsRemover, Tokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.enrich import score_of_prediction
from tidewire.session import cut


def training_rows(sentences: DataFrame) -> DataFrame:
    """(sentence_id, processed_sentence, label): scored sentences as classes 1..5; null sentences and scores are left out."""
    label = (F.col("Sentiment_Result") + 3).cast("double")
    rows = sentences.select("sentence_id", F.col("sentence").alias("processed_sentence"), label.alias("label"))
    return rows.filter("processed_sentence IS NOT NULL AND label IS NOT NULL")


def pipeline(vocabulary: int = 10_000, iterations: int = 1_000) -> Pipeline:
    words, kept, counts = (Tokenizer(inputCol="processed_sentence", outputCol="words"), StopWordsRemover(inputCol="words", outputCol="kept"), CountVectorizer(inputCol="kept", outputCol="counts", vocabSize=vocabulary, minDF=1.0))
    return Pipeline(stages=[words, kept, counts, IDF(inputCol="counts", outputCol="features", minDocFreq=1), LogisticRegression(maxIter=iterations)])


def split(rows: DataFrame, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the id, the same whatever the partitions are."""
    held = F.pmod(F.xxhash64("sentence_id", F.lit(seed)), F.lit(1000)) < test_share * 1000
    return rows.filter(~held), rows.filter(held)


def train(rows: DataFrame, vocabulary: int = 10_000, iterations: int = 1_000) -> tuple[PipelineModel, float, float]:
    """The model and its accuracy on training and test rows."""
    fit, held = split(cut(rows))
    model = pipeline(vocabulary, iterations).fit(fit)
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy")
    scores = [accuracy.evaluate(model.transform(x)) for x in (fit, held)]
    return model, scores[0], scores[1]


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """The saved model; fails at once if there is none."""
    return PipelineModel.load(path)


def score(model: PipelineModel, sentences: DataFrame, text: str = "sentence") -> DataFrame:
    """``sentences`` with ``predicted_score`` in -2..2, on batches and streams alike; null texts count as empty."""
    columns = sentences.columns
    out = model.transform(sentences.withColumn("processed_sentence", F.coalesce(text, F.lit(""))))
    return out.select(*columns, score_of_prediction(F.col("prediction")).alias("predicted_score"))
