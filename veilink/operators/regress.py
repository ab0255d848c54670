"""Encoded similarity as a function of plain similarity: samples, bins, models, adjustment."""

from __future__ import annotations

from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .prep import first_by_values, hash_split


def similarity_class(v: Column) -> Column:
    """The decile (lo, hi] as '0-1' to '9-10'; 'None' for values not above 0 or above 1."""
    out = F.when((v <= 0) | (v > 1), "None")
    for i in range(1, 11):
        out = out.when(v <= i / 10, f"{i - 1}-{i}")
    return out.otherwise("None")


def drawn(ids: list[str], seed: int) -> Column:
    """A hash of the ids to draw by, which SQL can repeat."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))).cast("binary"))


def sample_per_class(pairs: DataFrame, sim: str, ids: list[str], most: int = 500, seed: int = 0) -> DataFrame:
    """At most so many pairs of each class, in the order of a hash: a sampling operator, its cap is its purpose."""
    x = pairs.withColumn("sim_class", similarity_class(F.col(sim)))
    w = Window.partitionBy("sim_class").orderBy(drawn(ids, seed), *ids)
    return x.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def binned_difference(pairs: DataFrame, plain: str, encoded: str, step: float = 0.1) -> DataFrame:
    """``upper, mean, n``: mean encoded - plain similarity per bin of the plain one, from 1.0 down; bins above the first filled one
    are left out, empty ones below it have 0."""
    bins = round(1 / step)
    k = F.least(F.lit(bins - 1), F.floor((1.0 - F.col(plain)) * bins + 1e-9)).cast("int")
    made = pairs.groupBy(k.alias("k")).agg(F.avg(F.col(encoded) - F.col(plain)).alias("mean"), F.count(F.lit(1)).alias("n"))
    every = pairs.sparkSession.range(bins).select(F.col("id").cast("int").alias("k"))
    first = made.agg(F.min("k").alias("first"))
    return every.join(made, "k", "left").crossJoin(F.broadcast(first)).filter("k >= first").select(
        F.round(1.0 - F.col("k") / float(bins), 6).alias("upper"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("n", F.lit(0)).alias("n")
    )


class SimilarityModel:
    """'linear', 'isotonic' or 'poly' (degree 2); ``predict`` adds ``adjusted``."""

    def __init__(self, kind: str = "linear"):
        self.kind = kind

    def _features(self, df: DataFrame, columns: list[str]) -> DataFrame:
        made = VectorAssembler(inputCols=columns, outputCol="__f" if self.kind != "poly" else "__raw").transform(df)
        return PolynomialExpansion(degree=2, inputCol="__raw", outputCol="__f").transform(made) if self.kind == "poly" else made

    def fit(self, df: DataFrame, columns: list[str], label: str, weight: str | None = None) -> SimilarityModel:
        self.columns = columns
        extra = {"weightCol": weight} if weight else {}
        make = (IsotonicRegression if self.kind == "isotonic" else LinearRegression)(featuresCol="__f", labelCol=label, **extra)
        self.model = make.fit(self._features(df, columns))
        return self

    def save(self, path: str) -> None:
        """The fitted model and what it was fitted on; ``load`` reads it back."""
        self.model.write().overwrite().save(f"{path}/model")
        SparkSession.active().createDataFrame([(self.kind, self.columns)], "kind string, columns array<string>").write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, path: str) -> SimilarityModel:
        about = SparkSession.active().read.parquet(f"{path}/about").first()
        out = cls(about["kind"])
        out.columns = list(about["columns"])
        out.model = (IsotonicRegressionModel if out.kind == "isotonic" else LinearRegressionModel).load(f"{path}/model")
        return out

    def predict(self, df: DataFrame, name: str = "adjusted") -> DataFrame:
        return self.model.transform(self._features(df, self.columns)).select(*df.columns, F.col("prediction").alias(name))


def regression_quality(df: DataFrame, predicted: str, actual: str, weight: str | None = None) -> DataFrame:
    """Metrics over predictions above 0: explained variance, absolute errors, MSE, MSLE and R2. A row counts as many times as
    ``weight`` says."""
    p, y = F.col(predicted), F.col(actual)
    e = F.abs(y - p)
    rows = df.filter(p > 0)
    if weight:
        mean = lambda c: F.sum(F.col(weight) * c) / F.sum(weight)
        variance = lambda c: F.greatest(mean(c * c) - mean(c) * mean(c), F.lit(0.0))
        return rows.agg(
            (1.0 - F.try_divide(variance(y - p), variance(y))).alias("explained"), F.min(e).alias("least"), F.max(e).alias("largest"), mean(e).alias("mean"), F.sqrt(variance(e)).alias("deviation"),
            mean(e * e).alias("mse"), mean((F.ln(1 + y) - F.ln(1 + p)) ** 2).alias("msle"), (1.0 - F.try_divide(mean(e * e), variance(y))).alias("r2"),
        )
    return rows.agg(
        (1.0 - F.var_pop(y - p) / F.var_pop(y)).alias("explained"), F.min(e).alias("least"), F.max(e).alias("largest"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("deviation"),
        F.avg(e * e).alias("mse"), F.avg((F.ln(1 + y) - F.ln(1 + p)) ** 2).alias("msle"), (1.0 - F.avg(e * e) / F.var_pop(y)).alias("r2"),
    )


def trained_and_tested(pairs: DataFrame, ids: list[str], columns: list[str], label: str, kind: str = "linear", share: float = 0.75, seed: str = "42") -> tuple[SimilarityModel, DataFrame]:
    """A model fitted on a share of the pairs, by a hash of their ids, and its quality on the others."""
    keyed = pairs.withColumn("__id", F.concat_ws("|", *ids))
    train, test = (t.drop("__id") for t in hash_split(keyed, "__id", share, seed))
    model = SimilarityModel(kind).fit(train, columns, label)
    return model, regression_quality(model.predict(test), "adjusted", label)


def simple_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """``slope, intercept, r2`` of the one-predictor line."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def adjusted_edges(edges: DataFrame, slope: float, intercept: float, least: float) -> DataFrame:
    """Plain similarities put through the line, then filtered; they may exceed 1."""
    return edges.withColumn("sim", F.col("sim") * slope + intercept).filter(F.col("sim") >= least)


def cosine_histogram(pairs: DataFrame, cos: str, is_match: str, ids: list[str], digits: int = 3, over_sample: int = 1, seed: int = 0, n_matches: int | None = None) -> DataFrame:
    """``is_match, value, n``: cosine similarities of matches, and of so many times as many non-matches, first by a hash."""
    matches = pairs.filter(F.col(is_match) == 1)
    rest = pairs.filter(F.col(is_match) == 0).withColumn("__h", drawn(ids, seed)).withColumn("__first", F.substring("__h", 1, 4))
    rest = first_by_values(rest, [("__first", False), ("__h", False), *((c, False) for c in ids)], (matches.count() if n_matches is None else n_matches) * over_sample).drop("__h", "__first")
    return matches.unionByName(rest).groupBy(F.col(is_match).alias("is_match"), F.round(cos, digits).alias("value")).agg(F.count(F.lit(1)).alias("n"))
