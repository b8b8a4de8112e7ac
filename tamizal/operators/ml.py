"""Supervised routing: text features, classifiers, folds that keep groups together."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StringIndexer
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamizal.functions import text as T


def word_ngrams(c: Column) -> Column:
    """Words and pairs of neighbouring words of the normal form."""
    w = F.filter(F.split(T.norm(c), " "), lambda x: x != "")
    pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.array_join(F.slice(w, i, 2), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def char_ngrams(c: Column, low: int = 2, high: int = 5) -> Column:
    """Letter sequences of the normal form, words bounded by spaces."""
    padded = F.concat(F.lit(" "), T.norm(c), F.lit(" "))
    grams = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i, n=n: F.substring(padded, i, F.lit(n))) for n in range(low, high + 1)]
    return F.concat(*grams)


def features(df: DataFrame, text: str, chars: bool = False) -> DataFrame:
    """df with terms: what the classifiers are fitted on."""
    return df.withColumn("terms", char_ngrams(F.col(text)) if chars else word_ngrams(F.col(text)))


def folds(df: DataFrame, group: Column, k: int = 5) -> DataFrame:
    """df with fold: rows of one group are never in two folds."""
    return df.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(k)))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """df with fold: each label spread evenly."""
    return df.withColumn("fold", (F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(key), key)) - 1) % k)


class Sublinear(Transformer):
    """Counts n of a sparse vector as 1 + log(n)."""

    def __init__(self, source: str = "tf", target: str = "damped") -> None:
        super().__init__()
        self.source, self.target = source, target

    def _transform(self, dataset: DataFrame) -> DataFrame:
        damp = F.udf(lambda v: SparseVector(v.size, v.indices, 1.0 + np.log(v.values)), VectorUDT())  # Spark ML has no such stage
        return dataset.withColumn(self.target, damp(self.source))


def classifier(kind: str, label: str = "label", buckets: int = 1 << 16, rounds: int = 60) -> Pipeline:
    """TF-IDF with sublinear counts and unit length over hashed terms, then svm, bayes or logistic."""
    models = {"svm": OneVsRest(classifier=LinearSVC(regParam=1e-3, maxIter=rounds), labelCol="y"), "bayes": NaiveBayes(modelType="multinomial", smoothing=0.1, labelCol="y"), "logistic": LogisticRegression(regParam=1e-3, maxIter=rounds, family="multinomial", labelCol="y")}
    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="y", handleInvalid="skip"), HashingTF(inputCol="terms", outputCol="tf", numFeatures=buckets), Sublinear(), IDF(inputCol="damped", outputCol="weighted"), Normalizer(inputCol="weighted", outputCol="features", p=2.0), models[kind]])


def labels_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def cross_validated(df: DataFrame, kind: str, label: str, k: int = 5, buckets: int = 1 << 16, rounds: int = 60) -> DataFrame:
    """key columns with the prediction of a model that never saw the row's fold; df must have terms and fold."""
    out = None
    for i in range(k):
        model = classifier(kind, label, buckets, rounds).fit(df.where(F.col("fold") != i))
        names = F.array(*(F.lit(x) for x in labels_of(model)))
        part = model.transform(df.where(F.col("fold") == i)).withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1)).select(*df.columns, "predicted")
        out = part if out is None else out.unionByName(part)
    return out


