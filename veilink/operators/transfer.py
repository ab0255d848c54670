"""Transfer classification of comparison matrices: domain separation, instance selection, balancing, CORAL, source ranking."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .metrics import quality
from .prep import _border, first_by_hash, first_by_values, first_rows

METRICS = ["dice", "jaccard", "overlap", "hamming", "entropy"]
#: Fewest selected matches that a target classifier is trained on, and the target ratio of the two classes.
MIN_MATCHES, RATIO = 3, 2


def without_known(target: DataFrame, source: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """Target rows whose features, rounded half to even, no source row has."""
    rounded = lambda df: df.withColumns({f"__{c}": F.bround(c, digits) for c in columns})
    keys = [f"__{c}" for c in columns]
    return rounded(target).join(rounded(source).select(*keys).distinct(), keys, "left_anti").drop(*keys)


def domain_data(source: DataFrame, target: DataFrame, columns: list[str], anti: bool = True, weight: str | None = None) -> DataFrame:
    """Features (and ``weight``) with ``domain``: 0 for the source, 1 for the target, without target rows that look like source rows."""
    t, kept = without_known(target, source, columns) if anti else target, [*columns, *([weight] if weight else [])]
    return source.select(*kept, F.lit(0).alias("domain")).unionByName(t.select(*kept, F.lit(1).alias("domain")))


def _number(weight: str | None) -> Column:
    return F.coalesce(F.sum(weight), F.lit(0)) if weight else F.count(F.lit(1))


def first_counted(df: DataFrame, n: int, weight: str, pairs: Callable[[DataFrame], DataFrame], score: str | None = None, ties: tuple[str, ...] = ("id1", "id2")) -> DataFrame:
    """The first n rows by falling ``score`` (all alike without one), ties by ids, where distinct rows ``df`` count as ``weight`` says.

    ``pairs(rows)`` gives the ids of distinct rows, with their columns; it is called only where ids decide between distinct rows.
    """
    stay, same, left = df.limit(0), df, n
    if score:
        border = _border(df.groupBy(score).agg(F.sum(weight).alias("n")), F.desc(score), n)
        if border is None:
            return df
        value, before, _ = border
        stay, same, left = df.filter(F.col(score) > F.lit(value)), df.filter(F.col(score).eqNullSafe(F.lit(value))), n - before
    if left <= 0:
        return stay
    if same.limit(2).count() > 1:
        rest = [c for c in df.columns if c != weight]
        found = first_by_values(pairs(same), [(c, False) for c in ties], left)
        same = cut(found.groupBy(*rest).agg(F.count(F.lit(1)).alias(weight)).select(*df.columns))
    else:
        same = same.withColumn(weight, F.least(F.col(weight), F.lit(left)))
    return stay.unionByName(same)


def _assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="__f", handleInvalid="skip").transform(df)


class Classifier:
    """'logistic', 'svm' (with a Platt scale fitted on its margins), 'forest' or 'boosted'; ``proba`` adds a column."""

    def __init__(self, kind: str = "logistic", seed: int = 42):
        self.kind, self.seed, self.model, self.scale = kind, seed, None, None

    def fit(self, df: DataFrame, columns: list[str], label: str, weight: str | None = None, c: float = 1.0) -> Classifier:
        self.columns = columns
        rows = _assembled(df.withColumn("__y", F.col(label).cast("double")), columns)
        extra = {"weightCol": weight} if weight else {}
        if self.kind == "logistic":
            total = df.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0] or 1
            made = LogisticRegression(featuresCol="__f", labelCol="__y", regParam=1.0 / (c * float(total)), elasticNetParam=0.0, standardization=False, **extra)
        elif self.kind == "svm":
            made = LinearSVC(featuresCol="__f", labelCol="__y", regParam=0.01, **extra)
        elif self.kind == "forest":
            made = RandomForestClassifier(featuresCol="__f", labelCol="__y", numTrees=10, seed=self.seed, **extra)
        elif self.kind == "boosted":
            made = GBTClassifier(featuresCol="__f", labelCol="__y", maxIter=20, seed=self.seed, **extra)
        else:
            raise ValueError(f"unknown classifier {self.kind!r}")
        self.model = made.fit(rows)
        if self.kind == "svm":
            margins = self.model.transform(rows).select(vector_to_array("rawPrediction")[1].alias("m"), "__y")
            self.scale = LogisticRegression(featuresCol="__m", labelCol="__y").fit(VectorAssembler(inputCols=["m"], outputCol="__m").transform(margins))
        return self

    def proba(self, df: DataFrame, name: str = "pp") -> DataFrame:
        out = self.model.transform(_assembled(df, self.columns))
        if self.scale is not None:
            a, b = float(self.scale.coefficients[0]), float(self.scale.intercept)
            out = out.withColumn(name, 1.0 / (1.0 + F.exp(-(vector_to_array("rawPrediction")[1] * a + b))))
        else:
            out = out.withColumn(name, vector_to_array("probability")[1])
        return out.select(*df.columns, name)


def confident_instances(separator: Classifier, source: DataFrame, least: float = 0.51) -> DataFrame:
    """Source rows that look like the target, with their probability ``pp``."""
    return separator.proba(source).filter(F.col("pp") >= least)


def non_matches_to_keep(matches: int, share: float = 0.01) -> int:
    return int(matches * (1 - share) / share)


def balanced(df: DataFrame, matches: int, share: float = 0.01, label: str = "is_match", ties: tuple[str, ...] = ("id1", "id2"), counts: DataFrame | None = None) -> DataFrame:
    """All matches, and the non-matches of highest ``pp``, so many that matches are a share of all; ties by ids. ``counts`` (``pp, n``) of
    non-matches saves their count."""
    rest = first_by_values(df.filter(F.col(label) == 0), [("pp", True), *((c, False) for c in ties)], non_matches_to_keep(matches, share), counts)
    return rest.unionByName(df.filter(F.col(label) == 1))


def first_matches(df: DataFrame, n: int, order: list[str], label: str = "is_match") -> DataFrame:
    """Non-matches, and the first n matches."""
    return df.filter(F.col(label) == 0).unionByName(first_rows(df.filter(F.col(label) == 1), [F.col(order[0])], order[1:], n))


def covariance(df: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """``a, b, covariance`` (sample) of all pairs of columns, in one pass; in two, where a row counts as ``weight`` says."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i:]]
    if weight:
        w = F.col(weight)
        means = df.agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"__{c}") for c in columns])
        apart = lambda c: F.col(c) - F.col(f"__{c}")
        one = df.crossJoin(F.broadcast(means)).agg(*[F.try_divide(F.sum(w * apart(x) * apart(y)), F.sum(w) - 1).alias(f"c{i}") for i, (x, y) in enumerate(pairs)])
    else:
        one = df.agg(*[F.covar_samp(x, y).alias(f"c{i}") for i, (x, y) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{i}").alias("covariance")) for i, (x, y) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def coral(source: DataFrame, target: DataFrame, columns: list[str], ridge: float = 1.0, weight: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """The source with its metric columns whitened by its own covariance and coloured by the target's; or ``rows``, where source and target
    are distinct rows that count as ``weight`` says."""
    rows = source if rows is None else rows

    def matrix(df: DataFrame) -> np.ndarray:
        out, at = np.eye(len(columns)) * ridge, {c: i for i, c in enumerate(columns)}
        for r in covariance(df, columns, weight).collect():  # pairs of columns
            value = r["covariance"] or 0.0
            out[at[r["a"]], at[r["b"]]] += value
            if r["a"] != r["b"]:
                out[at[r["b"]], at[r["a"]]] += value
        return out

    def power(m: np.ndarray, p: float) -> np.ndarray:
        values, vectors = np.linalg.eigh(m)
        return (vectors * np.maximum(values, 1e-12) ** p) @ vectors.T

    a = power(matrix(source), -0.5) @ power(matrix(target), 0.5)
    made = {c: sum((F.col(x) * float(a[i, j]) for i, x in enumerate(columns[1:], 1)), F.col(columns[0]) * float(a[0, j])) for j, c in enumerate(columns)}
    return rows.select(*[made[c].alias(c) if c in made else F.col(c) for c in rows.columns])


#: Instance weights by name, over the probability of looking like the target.
WEIGHT_FUNCTIONS: dict[str, Callable[[Column], Column]] = {"pp": lambda w: w, "pp2": lambda w: w * w, "sqrt": lambda w: F.sqrt(w)}


def transfer(source: DataFrame, target: DataFrame, columns: list[str] | None = None, kind: str = "logistic", least: float = 0.51, share: float = 0.01, weights: dict[str, Callable[[Column], Column]] | None = None,
             weight: str | None = None, pairs: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One quality row per strategy, with ``stage1_strategy`` and ``status``: naive, tl-base, tl_pprl, tl_pprl++, coral, and tl_pprl-w
    for each weight function. Too few or too unbalanced selected rows end as a status, not as an error.

    With ``weight``, source and target are distinct rows that count as it says, and ``pairs`` is that of ``first_counted``.
    """
    columns = columns or METRICS
    separator = Classifier(kind).fit(domain_data(source, target, columns, weight=weight), columns, "domain", weight)
    chosen = cut(confident_instances(separator, source, least))
    counts = {r["is_match"]: r["n"] for r in chosen.groupBy("is_match").agg(_number(weight).alias("n")).collect()}
    matches, rest = counts.get(1, 0), counts.get(0, 0)
    spark = source.sparkSession
    rated = lambda df, name: quality(df, (F.col("pp") >= 0.5).cast("int"), "is_match", weight=weight).select(F.lit(name).alias("stage1_strategy"), F.lit("ok").alias("status"), "*")
    naive = rated(separator.proba(target), "naive")
    if matches < MIN_MATCHES or not rest:
        missing = spark.createDataFrame([("tl-base", f"{matches} matches and {rest} non-matches were selected")], "stage1_strategy string, status string")
        return naive.unionByName(missing, allowMissingColumns=True)
    if rest < RATIO * matches:
        n = max(1, int(rest / RATIO))
        if weight:
            chosen = chosen.filter("is_match = 0").unionByName(first_counted(chosen.filter("is_match = 1"), n, weight, pairs))
        else:
            chosen = first_matches(chosen, n, ["id1", "id2"])
        matches = min(matches, n)
    if weight:
        even = first_counted(chosen.filter("is_match = 0"), non_matches_to_keep(matches, share), weight, pairs, "pp").unionByName(chosen.filter("is_match = 1"))
    else:
        even = balanced(chosen, matches, share)
    sets = {"tl-base": (chosen, weight), "tl_pprl": (even, weight), "tl_pprl++": (coral(even, target, columns, weight=weight), weight), "coral": (coral(source, target, columns, weight=weight), weight)}
    for name, f in (weights if weights is not None else WEIGHT_FUNCTIONS).items():
        w = f(F.col("pp"))
        sets[f"tl_pprl-w:{name}"] = (even.withColumn("__w", w * F.col(weight) if weight else w), "__w")
    out = naive
    for name, (train, w) in sets.items():
        scored = Classifier(kind).fit(train, columns, "is_match", w).proba(target.select(*[c for c in target.columns if c != "pp"]))
        out = out.unionByName(rated(scored, name))
    return out


def source_bound(source: DataFrame, target: DataFrame, columns: list[str] | None = None, kind: str = "logistic", seed: str = "b", weight: str | None = None,
                 sample: Callable[[int], tuple[DataFrame, DataFrame]] | None = None) -> dict[str, float]:
    """The error bound of a source for a target: source error, half the domain distance, complexity, their sum, and the separator's MCC.

    With ``weight``, source and target are distinct rows that count as it says, and ``sample(n)`` gives the first n rows of both in the
    order of ``in_hash_order`` of their ids and ``seed``, counted likewise.
    """
    columns = columns or METRICS
    wrong = F.abs((F.col("pp") >= 0.5).cast("int") - F.col("is_match"))
    scored = Classifier(kind).fit(source, columns, "is_match", weight).proba(source)
    error = scored.agg(F.try_divide(F.sum(wrong * F.col(weight)), F.sum(weight)) if weight else F.avg(wrong)).first()[0]
    n = min(df.agg(_number(weight)).first()[0] for df in (source, target)) // 2
    kept = [*columns, *([weight] if weight else [])]
    first = lambda df: first_by_hash(df.withColumn("__id", F.concat_ws("|", "id1", "id2")), "__id", n, seed)
    sides = sample(n) if weight else (first(source), first(target))
    both = cut(sides[0].select(*kept, F.lit(0).alias("domain")).unionByName(sides[1].select(*kept, F.lit(1).alias("domain"))))
    scored = Classifier(kind).fit(both, columns, "domain", weight).proba(both).withColumn("p", (F.col("pp") >= 0.5).cast("int"))
    q = {(r["p"], r["domain"]): r["n"] for r in scored.groupBy("p", "domain").agg(_number(weight).alias("n")).collect()}
    tp, tn, fp, fn = q.get((1, 1), 0), q.get((0, 0), 0), q.get((1, 0), 0), q.get((0, 1), 0)
    total, d = max(1, tp + tn + fp + fn), len(columns)
    distance = 2 * (1 - (tn + tp) / total)
    base = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    complexity = 4 * math.sqrt((2 * d * math.log(max(2, total)) + math.log(2 / 0.5)) / max(1, total / 2))
    return {"e_s": float(error or 0), "dhh": distance / 2, "complement": complexity, "et": float(error or 0) + distance / 2 + complexity, "mcc": (tp * tn - fp * fn) / math.sqrt(base) if base else 0.0}


def rank_sources(sources: dict[str, DataFrame], targets: dict[str, DataFrame], columns: list[str] | None = None, kind: str = "logistic") -> list[dict]:
    """A bound for every source and other target; a pair that fails gives -1 everywhere, and the reason."""
    out = []
    for s, source in sources.items():
        for t, target in targets.items():
            if s != t:
                try:
                    out.append({"source": s, "target": t, "status": "ok", **source_bound(source, target, columns, kind)})
                except Exception as reason:  # one pair's failure must not end the grid
                    out.append({"source": s, "target": t, "status": str(reason)[:200], **dict.fromkeys(("e_s", "dhh", "complement", "et", "mcc"), -1.0)})
    return out


def run_grid(sources: dict[str, DataFrame], targets: dict[str, DataFrame], kinds: tuple[str, ...] = ("logistic",), columns: list[str] | None = None, thresholds: tuple[float, ...] = (0.7, 0.8, 0.9)) -> DataFrame:
    """Quality rows of every source, other target and classifier, and of plain thresholds on the mean metric."""
    from .metrics import threshold_quality

    columns, out = columns or METRICS, None
    for t, target in targets.items():
        mean = target.withColumn("mean", sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / float(len(columns)))
        plain = threshold_quality(mean, "mean", "is_match", list(thresholds)).select(F.concat(F.lit("threshold:"), F.col("threshold").cast("string")).alias("stage1_strategy"), F.lit("ok").alias("status"), *["precision", "recall", "f1", "accuracy", "predicted_0", "predicted_1", "actual_0", "actual_1"])
        parts = [("", "", plain)] + [(s, k, transfer(source, target, columns, k)) for s, source in sources.items() if s != t for k in kinds]
        for s, k, rows in parts:
            rows = rows.select(F.lit(s).alias("source"), F.lit(t).alias("target"), F.lit(k).alias("stage1_model"), "*")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
