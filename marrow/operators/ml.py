"""Trainable baseline (X8): Spark ML text classifier + the G18/G19 metrics.

Stands in for the source's single-GPU networks: a distributed
``HashingTF -> IDF -> LogisticRegression`` pipeline trained on the training
split and scored on a held-out split.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.functions import text as tx


def baseline_pipeline(text: str = "text", label: str = "label", num_features: int = 1 << 18,
                      max_iter: int = 50, reg: float = 0.01) -> Pipeline:
    tok = RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=tx.WS + "+", toLowercase=True)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_features")
    lr = LogisticRegression(featuresCol="_features", labelCol=label, maxIter=max_iter, regParam=reg,
                            predictionCol="_pred", probabilityCol="_prob", rawPredictionCol="_raw")
    return Pipeline(stages=[tok, tf, idf, lr])


def train(df: DataFrame, text: str = "text", label: str = "label", **kw) -> PipelineModel:
    return baseline_pipeline(text, label, **kw).fit(df.select(text, F.col(label).cast("double").alias(label)))


def predict(model: PipelineModel, df: DataFrame, key: str, label: str = "label") -> DataFrame:
    out = model.transform(df)
    return out.select(key, F.col(label).cast("long").alias("label"),
                      F.col("_pred").cast("long").alias("prediction"))
