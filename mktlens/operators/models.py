"""A logistic model of winning events, by Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import folders
from .statistics import auc

FEATURES = ("price", "size_percentile", "size_zscore", "price_trend_30m", "ofi_scaled", "minutes_scaled", "is_tail_n", "is_against_ofi_n")


def logistic_report(events: DataFrame, penalty: float = 0.01) -> DataFrame:
    """AUC of the first 60, next 20 and last 20 percent of the days' events, each feature's weight; from 50 events on.

    Days are split, not events: their counts are small, and no event is ordered in one task.
    """
    rows = events.where("outcome_won is not null").withColumns(
        {
            "ofi_scaled": F.col("ofi_30m") / 100_000, "minutes_scaled": F.col("minutes_before_close") / 1440, "is_tail_n": F.col("is_tail").cast("double"), "is_against_ofi_n": F.col("is_against_ofi").cast("double"),
            "label": F.col("outcome_won").cast("double"), "day": F.to_date("ts"),
        }
    ).na.fill(0.0, list(FEATURES))
    days = rows.groupBy("day").agg(F.count(F.lit(1)).alias("m"))
    share = F.sum("m").over(Window.partitionBy().orderBy("day")) / F.sum("m").over(Window.partitionBy())
    part = F.when(share <= 0.6, "train").when(share <= 0.8, "validation").otherwise("test")
    # read several times and by each round of the fit
    rows = folders.cut(rows.join(days.select("day", part.alias("part")), "day").select(*FEATURES, "outcome_won", "label", "part"))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows)
    train = rows.where("part = 'train'")
    empty = events.sparkSession.createDataFrame([], "name string, value double")
    if rows.count() < 50 or train.select("label").distinct().count() < 2:
        return empty
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=penalty, elasticNetParam=0.0, standardization=False).fit(train)
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    areas = auc(scored, "score", "outcome_won", ("part",)).select(F.concat(F.lit("auc_"), "part").alias("name"), F.col("auc").alias("value"))
    weights = events.sparkSession.createDataFrame([(f"weight_{n}", float(w)) for n, w in zip(FEATURES, model.coefficients, strict=True)], "name string, value double")
    return areas.unionByName(weights)
