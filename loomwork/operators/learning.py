"""Text classification: vocabulary, baseline, and logistic regression chosen on validation data."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators.evaluation import classification_report


def vocabulary(docs: DataFrame, text: str, least: int = 2, most: int = 50_000) -> DataFrame:
    """``(word, n, id)``: words by frequency, ties by name; ids from 2 (0 pads, 1 is unknown)."""
    counts = docs.select(F.explode(T.syllables(T.nfc(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    best = counts.orderBy(F.desc("n"), "word").limit(most)  # bounded, so one ranking task is enough
    return best.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "word")) + 1)


def encoded(docs: DataFrame, key: str, text: str, words: DataFrame, length: int) -> DataFrame:
    """``(key, ids, n)``: word ids cut and padded to ``length``; an empty text is one unknown word."""
    cut_ = docs.select(F.col(key).alias("_key"), F.slice(T.syllables(T.nfc(text)), 1, length).alias("_w"))
    long = cut_.select("_key", F.posexplode_outer("_w").alias("_p", "_word"))
    known = words.select(F.col("word").alias("_word"), F.col("id").alias("_id"))
    ids = long.join(known, "_word", "left").groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("_p", F.lit(0)).alias("p"), F.coalesce("_id", F.lit(1)).alias("i")))), lambda s: s["i"]).alias("_ids"))
    return ids.select(F.col("_key").alias(key), F.concat("_ids", F.array_repeat(F.lit(0), F.lit(length) - F.size("_ids"))).alias("ids"), F.size("_ids").alias("n"))


def cut_length(docs: DataFrame, text: str, share: float = 0.95) -> DataFrame:
    """``(length)``: the length that ``share`` of the texts don't exceed, rounded up."""
    return docs.agg(F.ceil(F.percentile(F.size(T.syllables(text)), F.lit(share))).alias("length"))


def majority(train: DataFrame, label: str) -> Column:
    """The most frequent label of the training rows, ties to the smallest."""
    row = train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(1).collect()
    return F.lit(row[0][label] if row else None)


def text_features(text: str, features: int = 200_000, min_docs: int = 2) -> list:
    """Stages from a word array column: words and word pairs, counts, idf, unit length."""
    return [
        NGram(n=2, inputCol=text, outputCol="_pairs"),
        CountVectorizer(inputCol=text, outputCol="_c1", vocabSize=features, minDF=min_docs),
        CountVectorizer(inputCol="_pairs", outputCol="_c2", vocabSize=features, minDF=min_docs),
        IDF(inputCol="_c1", outputCol="_i1"),
        IDF(inputCol="_c2", outputCol="_i2"),
        VectorAssembler(inputCols=["_i1", "_i2"], outputCol="_f"),
        Normalizer(inputCol="_f", outputCol="_features"),
    ]


def logistic(train: DataFrame, validation: DataFrame, text: str, label: str, strengths: tuple[float, ...] = (0.3, 1.0, 3.0, 10.0), features: int = 200_000) -> tuple[PipelineModel, float]:
    """The model with the best macro F1 on validation among the inverse
    regularisation strengths, and that score. Rows without label are left out."""
    words = T.syllables(T.nfc(text))
    rows = train.where(F.col(label).isNotNull()).withColumn("_words", words)
    prepared = Pipeline(stages=[StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep"), *text_features("_words", features)]).fit(rows)
    ready = prepared.transform(rows).select("_label", "_features").persist()
    n = max(1, ready.count())
    labels = prepared.stages[0].labels
    checked = prepared.transform(validation.where(F.col(label).isNotNull()).withColumn("_words", words)).select("_label", "_features").persist()
    best: tuple[float, object] = (-1.0, None)
    try:
        for c in strengths:
            model = LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="_said", probabilityCol="_p", rawPredictionCol="_raw", regParam=1 / (c * n), standardization=False, maxIter=60).fit(ready)
            score = classification_report(model.transform(checked), "_label", "_said", [float(i) for i in range(len(labels))]).collect()[0]["macro_f1"] or 0.0
            if score > best[0]:
                best = (score, model)
    finally:
        ready.unpersist()
        checked.unpersist()
    return PipelineModel(stages=[*prepared.stages, best[1]]), best[0]


def predict(model: PipelineModel, rows: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """``(key, label, predicted)``."""
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    out = model.transform(rows.where(F.col(label).isNotNull()).withColumn("_words", T.syllables(T.nfc(text))))
    return out.select(key, label, F.try_element_at(names, F.col("_said").cast("int") + 1).alias("predicted"))
