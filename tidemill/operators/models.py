"""pyspark.ml wrappers: calibration, three-class models, a meta-labeler, purged cross-validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def feature_columns(df: DataFrame, leave: set[str], prefix: str | None = None) -> list[str]:
    """Numeric columns apart from some names and, if given, those with a prefix."""
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in leave and not (prefix and f.name.startswith(prefix))]


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    """A vector column of the features; absent ones count as 0, nulls and NaN as well."""
    have = {c for c in df.columns}
    for c in columns:
        x = F.col(c).cast("double") if c in have else F.lit(0.0)
        df = df.withColumn(c, F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def train_classifier(df: DataFrame, columns: list[str], label: str, weight: str | None = None, trees: int = 50, depth: int = 6, seed: int = 7) -> Model:
    """A random forest over the features, with class-balancing weights if named."""
    est = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return (est.setWeightCol(weight) if weight else est).fit(assemble(df, columns))


def predict_signal(model: Model, df: DataFrame, columns: list[str]) -> DataFrame:
    """signal (P(up) - P(down)), confidence and direction of a three-class model."""
    p = vector_to_array(F.col("probability"))
    d = model.transform(assemble(df, columns)).withColumns({"signal": p[2] - p[0], "confidence": F.array_max(p)})
    return d.withColumn("direction", F.when(F.col("signal") > 0.1, "long").when(F.col("signal") < -0.1, "short").otherwise("neutral")).drop("features", "rawPrediction", "probability", "prediction")


def importances(model: Model, columns: list[str], top: int = 30) -> list[tuple[str, float]]:
    """The most important features."""
    return sorted(zip(columns, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])[:top]


def meta_precision(model: Model, df: DataFrame, columns: list[str], label: str, threshold: float = 0.55) -> DataFrame:
    """Trades a binary model lets through at the threshold, and how many of them were right."""
    d = model.transform(assemble(df, columns)).withColumn("p", vector_to_array("probability")[1])
    taken = F.col("p") >= threshold
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(taken).alias("taken"), F.try_divide(F.count_if(taken & (F.col(label) == 1)), F.count_if(taken)).alias("precision"))


def purged_score(df: DataFrame, folds: DataFrame, rn: str, make: Callable[[], Estimator], score: Callable[[DataFrame], float], k: int) -> list[float]:
    """Score of a fresh model on each test fold, trained on the rows the fold table calls training.

    The joined rows are kept while the folds are fitted, since every fit reads them several times.
    """
    rows, out = df.join(folds, rn).persist(), []
    try:
        for i in range(k):
            part = rows.filter(F.col("fold") == i)
            out.append(score(make().fit(part.filter("role = 'train'")).transform(part.filter("role = 'test'"))))
    finally:
        rows.unpersist()
    return out


def fit_calibration(df: DataFrame, confidence: str, correct: str, points: int = 101) -> list[float]:
    """Isotonic accuracy on a grid of confidences from 0 to 1."""
    m = IsotonicRegression(featuresCol=confidence, labelCol=correct).fit(df.select(F.col(confidence).cast("double").alias(confidence), F.col(correct).cast("double").alias(correct)))
    return [float(m.predict(i / (points - 1))) for i in range(points)]


def calibrate(confidence: Column, grid: list[float]) -> Column:
    """Linear interpolation on the grid, never above the confidence itself."""
    g, n = F.array(*[F.lit(x) for x in grid]), len(grid) - 1
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)) * n
    i = F.least(F.floor(x), F.lit(n - 1)).cast("int")
    return F.least(confidence, F.get(g, i) + (x - i) * (F.get(g, i + 1) - F.get(g, i)))
