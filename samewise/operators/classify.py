"""A classifier of record pairs: logistic regression on hashed words and on how alike the two texts are.

It stands where the reference fine-tunes a language model, which needs weights that cannot be had offline. The interface is the same:
labelled pairs of texts in, a model and its metrics out.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.functions import text as T
from samewise.operators.evaluate import classification


def featured(pairs: DataFrame) -> DataFrame:
    """text1, text2 and labels with words, the common share of words and of character trigrams, and the difference in length."""
    words = lambda c: T.tokens(T.clean_str(F.coalesce(F.col(c), F.lit(""))))
    out = pairs.withColumn("w1", words("text1")).withColumn("w2", words("text2"))
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(F.array_join(c, " ")) - 2, F.lit(1))), lambda i: F.substr(F.array_join(c, " "), i, F.lit(3)))
    out = out.withColumn("words", F.concat(F.array_intersect("w1", "w2"), F.transform(F.array_except("w1", "w2"), lambda x: F.concat(F.lit("1_"), x)), F.transform(F.array_except("w2", "w1"), lambda x: F.concat(F.lit("2_"), x))))
    out = out.withColumn("alike", F.coalesce(T.set_jaccard(F.array_distinct("w1"), F.array_distinct("w2")), F.lit(0.0)))
    out = out.withColumn("alike_grams", F.coalesce(T.set_jaccard(F.array_distinct(grams("w1")), F.array_distinct(grams("w2"))), F.lit(0.0)))
    longer = F.greatest(F.size("w1"), F.size("w2"))
    return out.withColumn("apart", F.when(longer > 0, F.abs(F.size("w1") - F.size("w2")) / longer).otherwise(0.0)).drop("w1", "w2")


def fitted(pairs: DataFrame, features: int = 1 << 12, rounds: int = 50, weight: str | None = None) -> PipelineModel:
    """weight: a column with the number of pairs that a row stands for, where equal pairs are one row."""
    stages = [
        HashingTF(inputCol="words", outputCol="tf", numFeatures=features, binary=True),
        VectorAssembler(inputCols=["alike", "alike_grams", "apart", "tf"], outputCol="features"),
        LogisticRegression(labelCol="labels", featuresCol="features", regParam=0.05, maxIter=rounds, **({"weightCol": weight} if weight else {})),
    ]
    return Pipeline(stages=stages).fit(featured(pairs))


def scored(model: PipelineModel, pairs: DataFrame, weight: str | None = None) -> DataFrame:
    return model.transform(featured(pairs)).select("text1", "text2", "labels", F.col("prediction").cast("int").alias("prediction"), *([weight] if weight else []))


def tested(model: PipelineModel, pairs: DataFrame, weight: str | None = None) -> DataFrame:
    return classification(scored(model, pairs, weight), "labels", "prediction", weight)
