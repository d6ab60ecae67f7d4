"""Text classifiers on Spark ML: word and character n-grams, logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import binary


def featurizer(text: str, code: bool = False, size: int = 1 << 15) -> list:
    """Stages for words (or C tokens), word pairs and character 3-grams within words, weighted and of unit length."""
    pattern = r"[A-Za-z_][A-Za-z0-9_]*|\d+\.?\d*|[^\sA-Za-z0-9_]" if code else r"(?U)\w\w+"
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=pattern, gaps=False, toLowercase=not code),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        RegexTokenizer(inputCol=text, outputCol="_chars", pattern=r"(?s)[^\s](?=[^\s]{2})|[^\s]", gaps=False),
        NGram(n=3, inputCol="_chars", outputCol="_grams"),
    ]
    for c, n in (("_words", size), ("_pairs", size), ("_grams", size)):
        stages += [HashingTF(inputCol=c, outputCol=f"{c}_tf", numFeatures=n), IDF(inputCol=f"{c}_tf", outputCol=f"{c}_w", minDocFreq=2)]
    stages += [VectorAssembler(inputCols=["_words_w", "_pairs_w", "_grams_w"], outputCol="_all"), Normalizer(inputCol="_all", outputCol="features")]
    return stages


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight`` so that all classes weigh the same."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return df.join(F.broadcast(n), label).join(F.broadcast(total), F.lit(True)).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def text_classifier(df: DataFrame, text: str, label: str, c: float = 3.0, rounds: int = 30, code: bool = False) -> PipelineModel:
    """Balanced multinomial logistic regression on ``featurizer``; null labels and texts are left out."""
    rows = balanced(df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double")), label)
    total = rows.agg(F.sum("weight")).first()[0] or 1.0
    lr = LogisticRegression(labelCol=label, weightCol="weight", family="multinomial", regParam=1.0 / (c * total), standardization=False, maxIter=rounds, aggregationDepth=3)
    return Pipeline(stages=[*featurizer(text, code), lr]).fit(rows)


def classified(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., prediction, confidence): the first class of the highest probability."""
    out = model.transform(df)
    p = vector_to_array("probability")
    return out.select(*keep, F.array_position(p, F.array_max(p)).cast("int").alias("_at"), F.array_max(p).alias("confidence")).withColumn("prediction", F.col("_at") - 1).drop("_at")


def held_out_group(df: DataFrame, text: str, label: str, group: str, value: str, **params) -> DataFrame:
    """Rates on the rows of one group by a model that never saw it."""
    rows = df.where(F.col(label).isNotNull())
    model = text_classifier(rows.where(~F.col(group).eqNullSafe(value)), text, label, **params)
    return binary(classified(model, rows.where(F.col(group) == value), [label]), label, "prediction")
