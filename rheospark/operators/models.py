"""Models as Spark jobs: pipelines, two-stage and hybrid models, experts, forests of isolation trees, neighbours.

Tables are fitted with pyspark.ml; what a model needs of all rows (means, medians, normal equations, covariances) is
aggregated by Spark, and only results as small as the list of features reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel, tuning
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import Bucketizer, Imputer, StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggs import fingerprint
from .metrics import error_aggs, regression_metrics
from .quantiles import percentiles
from ..sources.io import cut


#: Rows of a task that fits trees, about.
CV_ROWS = 2_000_000
#: Bins of a column for trees, as of pyspark.ml.
BINS = 32
#: Cells of a route up to which its expert is fitted in one task.
CELLS = 100_000


def doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns})


def preprocess(columns: list[str], output: str = "features", scale: bool = True, least_variance: float = 0.0) -> Pipeline:
    """Median for missing values, one vector, constant columns dropped, unit deviation."""
    filled = [f"{c}__f" for c in columns]
    stages = [Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol=f"{output}__v", handleInvalid="keep")]
    stages.append(VarianceThresholdSelector(varianceThreshold=least_variance, featuresCol=f"{output}__v", outputCol=f"{output}__s" if scale else output))
    if scale:
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol=f"{output}__s", outputCol=output))
    return Pipeline(stages=stages)


def ridge(features: str = "features", label: str = "label", output: str = "prediction", reg: float = 1.0, weight: str | None = None, loss: str = "squaredError") -> LinearRegression:
    more = {"weightCol": weight} if weight else {}
    return LinearRegression(featuresCol=features, labelCol=label, predictionCol=output, regParam=reg, elasticNetParam=0.0, loss=loss, solver="normal" if loss == "squaredError" else "l-bfgs", **more)


def gbt(features: str = "features", label: str = "label", output: str = "prediction", weight: str | None = None, trees: int = 30, depth: int = 4, seed: int = 42) -> GBTRegressor:
    more = {"weightCol": weight} if weight else {}
    return GBTRegressor(featuresCol=features, labelCol=label, predictionCol=output, maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed, **more)


def _drop_work(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith(("__f", "__b", "__v", "__s"))])


@dataclass
class Fitted:
    """A fitted pipeline and the column it adds."""

    model: PipelineModel
    output: str
    vector: str

    def transform(self, df: DataFrame) -> DataFrame:
        return _drop_work(self.model.transform(df)).drop(self.vector)


def cut_points(df: DataFrame, columns: list[str], by: str | None = None, bins: int = BINS) -> DataFrame:
    """Where the bins of each column part, for each `by`: by, column, cuts. Halfway between values where there are no more than
    `bins`, as pyspark.ml's trees have it, else at exact percentiles, `bins` - 1 at most. Equal values are counted once."""
    keys = [by] if by else []
    counts = None
    for c in columns:
        own = df.where(F.col(c).isNotNull()).groupBy(*keys, F.col(c).alias("value")).agg(F.count("*").alias("n")).select(*keys, F.lit(c).alias("column"), "value", "n")
        counts = own if counts is None else counts.unionByName(own)
    counts = cut(counts, "values")
    sizes = counts.groupBy(*keys, "column").agg(F.count("*").alias("_d"))
    sizes = cut(sizes, "sizes")
    few = counts.join(sizes.where(F.col("_d") <= bins), [*keys, "column"]).groupBy(*keys, "column").agg(F.array_sort(F.collect_list("value")).alias("v"))
    n = F.size("v")
    between = F.zip_with(F.slice("v", F.lit(1), n - 1), F.slice("v", F.lit(2), n - 1), lambda a, b: (a + b) / 2)
    many = percentiles(counts.join(sizes.where(F.col("_d") > bins), [*keys, "column"], "left_semi"), [*keys, "column"], {"cuts": "value"}, [i / bins for i in range(1, bins)], count="n")
    return few.select(*keys, "column", between.alias("cuts")).unionByName(many.select(*keys, "column", F.array_distinct("cuts").alias("cuts")))


def fit_trees(df: DataFrame, columns: list[str], label: str, learner, vector: str, weight: str | None = None, classes: bool = False) -> PipelineModel:
    """A pipeline of pyspark.ml with the trees of `learner`, whose features are `vector`, fitted on cells in place of rows.

    Trees see the bin of a value only, and a split by least squares only sums: so rows that agree in all bins (and in the class)
    count as one row with their mean label and the sum of their weights, and the trees are those of all rows. There are no more
    cells than rows, and BINS ** columns at most. A learner makes some hundred passes over its rows."""
    filled, binned = [f"{c}__f" for c in columns], [f"{c}__b" for c in columns]
    rows = doubles(df.where(F.col(label).isNotNull()), columns)
    imputer = Imputer(strategy="median", inputCols=columns, outputCols=filled).fit(rows)
    rows = imputer.transform(rows)
    found = {r["column"]: list(r["cuts"]) for r in cut_points(rows, filled).collect()}
    splits = [[-math.inf, *(found.get(c) or [0.0]), math.inf] for c in filled]
    buckets = Bucketizer(splitsArray=splits, inputCols=filled, outputCols=binned, handleInvalid="keep")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = buckets.transform(rows).where(w > 0).groupBy(*binned, *([F.col(label).alias("_y")] if classes else [])).agg(F.sum(w).alias("_w"), F.sum(w * F.col(label)).alias("_s"))
    plain = [F.col(c).alias(c, metadata={}) for c in binned]  # a bucket is an ordered number, not a category
    cells = cut(cells.select(*plain, (F.col("_s") / F.col("_w")).alias("_label"), F.col("_w").alias("_weight")), "cells")
    cells = cells.coalesce(-(-cells.count() // CELLS) or 1)
    assembler = VectorAssembler(inputCols=binned, outputCol=vector)
    model = learner.setLabelCol("_label").setWeightCol("_weight").fit(assembler.transform(cells))
    return PipelineModel([imputer, buckets, assembler, model])


def fit_regression(df: DataFrame, columns: list[str], label: str, output: str, kind: str = "ridge", weight: str | None = None, **more) -> Fitted:
    vector = f"{output}__features"
    rows = df.where(F.col(label).isNotNull())
    if kind == "gbt":
        return Fitted(fit_trees(rows, columns, label, gbt(vector, "_label", output, **more), vector, weight), output, vector)
    learner = ridge(vector, label, output, weight=weight, loss="huber", reg=more.get("reg", 1.0)) if kind == "huber" else ridge(vector, label, output, weight=weight, **more)
    return Fitted(Pipeline(stages=[preprocess(columns, vector), learner]).fit(rows), output, vector)


@dataclass
class BaselineModel:
    """Ridge on recipe columns, behind the mean label of the compound and of its base compound; or with the compound's mean
    residual added (bias)."""

    columns: list[str]
    label: str
    compound: str
    base: str | None = None
    bias: bool = False
    ridge_model: Fitted | None = None
    tables: list[tuple[str, DataFrame]] = field(default_factory=list)

    def fit(self, train: DataFrame) -> BaselineModel:
        self.ridge_model = fit_regression(train, self.columns, self.label, "ridge")
        target = F.col(self.label)
        rows = self.ridge_model.transform(train) if self.bias else train
        if self.bias:
            target = target - F.col("ridge")
        keys = [self.compound] if self.bias or not self.base else [self.compound, self.base]
        self.tables = [(k, rows.groupBy(k).agg(F.avg(target).alias(f"_m{i}"))) for i, k in enumerate(keys)]
        return self

    def transform(self, df: DataFrame, output: str = "baseline") -> DataFrame:
        out = self.ridge_model.transform(df)
        for k, t in self.tables:
            out = out.join(t, k, "left")
        means = [F.col(f"_m{i}") for i in range(len(self.tables))]
        value = F.col("ridge") + F.coalesce(means[0], F.lit(0.0)) if self.bias else F.coalesce(*means, F.col("ridge"))
        return out.withColumn(output, value).drop("ridge", *[f"_m{i}" for i in range(len(self.tables))])


@dataclass
class DeviationTransformer:
    """dev_<c>: each process column less what a ridge on the recipe columns expects. The normal equations of all columns
    come from one pass: sums of products, as many as recipe x (recipe + process) columns."""

    recipe: list[str]
    process: list[str]
    reg: float = 1.0
    beta: np.ndarray | None = None
    centre: tuple[np.ndarray, np.ndarray] | None = None

    def fit(self, train: DataFrame) -> DeviationTransformer:
        columns = [*self.recipe, *self.process]
        rows = doubles(train, columns)
        means = rows.agg(*[F.avg(c).alias(c) for c in columns]).first()
        m = {c: means[c] or 0.0 for c in columns}
        d = {c: F.coalesce(F.col(c), F.lit(m[c])) - F.lit(m[c]) for c in columns}
        pairs = [(a, b) for i, a in enumerate(self.recipe) for b in [*self.recipe[i:], *self.process]]
        sums = rows.agg(*[F.sum(d[a] * d[b]).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]).first()
        value = {p: sums[i] or 0.0 for i, p in enumerate(pairs)}
        xx = np.array([[value.get((a, b), value.get((b, a))) for b in self.recipe] for a in self.recipe])
        xy = np.array([[value[a, c] for c in self.process] for a in self.recipe])
        self.beta = np.linalg.solve(xx + self.reg * np.eye(len(self.recipe)), xy)
        self.centre = np.array([m[c] for c in self.recipe]), np.array([m[c] for c in self.process])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        rows = doubles(df, [*self.recipe, *self.process])
        x = [F.coalesce(F.col(c), F.lit(float(v))) - float(v) for c, v in zip(self.recipe, self.centre[0], strict=True)]
        out = {}
        for j, c in enumerate(self.process):
            expected = sum((float(self.beta[i, j]) * x[i] for i in range(len(x))), F.lit(float(self.centre[1][j])))
            out[f"dev_{c}"] = F.coalesce(F.col(c) - expected, F.lit(0.0))
        return rows.withColumns(out)


@dataclass
class TwoStageModel:
    """Baseline on the recipe, then trees or ridge on the process deviations for what remains; clipped."""

    recipe: list[str]
    process: list[str]
    label: str
    compound: str
    kind: str = "gbt"
    low: float = 15.0
    high: float = 95.0

    def fit(self, train: DataFrame) -> TwoStageModel:
        self.baseline = BaselineModel(self.recipe, self.label, self.compound).fit(train)
        self.deviations = DeviationTransformer(self.recipe, self.process).fit(train)
        rows = self.deviations.transform(self.baseline.transform(train)).withColumn("_rest", F.col(self.label) - F.col("baseline"))
        self.rest = fit_regression(rows, [f"dev_{c}" for c in self.process], "_rest", "process_part", self.kind)
        return self

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        out = self.rest.transform(self.deviations.transform(self.baseline.transform(df)))
        value = F.col("baseline") + F.col("process_part")
        return out.withColumn(output, F.greatest(F.lit(self.low), F.least(F.lit(self.high), value))).drop(*[f"dev_{c}" for c in self.process])


def _split(bins: np.ndarray, w: np.ndarray, y: np.ndarray, depth: int) -> list:
    """A tree by least squares over bins: a node [column, last bin to the left, left, right], or a leaf [mean]."""
    whole, total = w.sum(), w @ y
    best = (1e-12 * (w @ y**2), None, None)
    for f in range(bins.shape[1] if depth else 0):
        n, t = np.cumsum(np.bincount(bins[:, f], w)), np.cumsum(np.bincount(bins[:, f], w * y))
        at = np.flatnonzero((n[:-1] > 0) & (np.diff(n) > 0) & (n[:-1] < n[-1]))
        if len(at):
            gain = t[at] ** 2 / n[at] + (total - t[at]) ** 2 / (whole - n[at]) - total**2 / whole
            if gain.max() > best[0]:
                best = (gain.max(), f, int(at[gain.argmax()]))
    _, f, last = best
    if f is None:
        return [float(total / whole)]
    left = bins[:, f] <= last
    return [f, last, _split(bins[left], w[left], y[left], depth - 1), _split(bins[~left], w[~left], y[~left], depth - 1)]


def _leaves(bins: np.ndarray, tree: list) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(bins), tree[0])
    left, out = bins[:, tree[0]] <= tree[1], np.empty(len(bins))
    out[left], out[~left] = _leaves(bins[left], tree[2]), _leaves(bins[~left], tree[3])
    return out


def _boosted(bins: np.ndarray, w: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 4, step: float = 0.1) -> list[list]:
    """The trees of gbt() for cells: the first counts whole, each other by `step`, fitted on twice what remains."""
    forest, so_far = [], np.zeros(len(y))
    for i in range(trees):
        forest.append(_split(bins, w, 2 * (y - so_far) if i else y, depth))
        so_far += (step if i else 1.0) * _leaves(bins, forest[-1])
    return forest


def _small_ridge(x: np.ndarray, y: np.ndarray, reg: float = 1.0) -> np.ndarray:
    """Intercept and coefficients of preprocess() and ridge() for a few rows."""
    mean, spread, of_y = x.mean(axis=0), x.std(axis=0), y.std()
    use = np.flatnonzero(spread > 0)
    beta = np.zeros(x.shape[1] + 1)
    if len(use) and of_y > 0:
        z = (x[:, use] - mean[use]) / spread[use]
        beta[1 + use] = np.linalg.solve(z.T @ z / len(y) + reg / of_y * np.eye(len(use)), z.T @ (y - y.mean()) / len(y)) / spread[use]
    beta[0] = y.mean() - beta[1:] @ mean
    return beta


@dataclass
class RouteExperts:
    """One expert per route, fitted together: trees as of gbt() over each route's own bins, or ridge for few rows.

    Rows are counted by route and bins once (see fit_trees()); a route's cells, CELLS at most, give its trees in a task. Routes
    with more cells are fitted by gbt(), one after the other; there are no more of them than cells / CELLS."""

    route: str
    columns: list[str]
    label: str
    min_rows: int = 30

    def fit(self, train: DataFrame) -> RouteExperts:
        import json

        rows = train.where(F.col(self.route).isNotNull() & F.col(self.label).isNotNull()).select(self.route, *self.columns, F.col(self.label).alias("_y"))
        counts = cut(rows.groupBy(self.route).agg(F.count("*").alias("_n")), "routes")
        kind = rows.schema[self.route].dataType.simpleString()
        columns, route = self.columns, self.route

        def ridges(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({route: pdf[route].iloc[:1].to_numpy(), "_beta": [_small_ridge(pdf[columns].to_numpy(float), pdf["_y"].to_numpy(float)).tolist()]})

        few = rows.join(counts.where(F.col("_n") < self.min_rows), self.route, "left_semi")
        self.ridges = cut(few.groupBy(self.route).applyInPandas(ridges, f"`{route}` {kind}, _beta array<double>"), "ridges")
        many = rows.join(counts.where(F.col("_n") >= self.min_rows), self.route, "left_semi")
        cuts = cut_points(many, columns, self.route).groupBy(self.route).agg(*[F.max(F.when(F.col("column") == c, F.col("cuts"))).alias(f"_c{i}") for i, c in enumerate(columns)])
        self.cuts = cut(cuts, "cuts")
        cells = cut(self._binned(many).groupBy(self.route, "_bins").agg(F.count("*").alias("_w"), F.avg("_y").alias("_y")), "cells")
        sizes = cut(cells.groupBy(self.route).agg(F.count("*").alias("_d")), "sizes")

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.assign(_at=pdf["_bins"].map(tuple)).sort_values("_at")  # sums in one order, whatever the rows came in
            made = _boosted(np.array(pdf["_at"].to_list()), pdf["_w"].to_numpy(float), pdf["_y"].to_numpy(float))
            return pd.DataFrame({route: pdf[route].iloc[:1].to_numpy(), "_forest": [json.dumps(made)]})

        own = cells.join(sizes.where(F.col("_d") <= CELLS), self.route, "left_semi")
        self.forests = cut(own.groupBy(self.route).applyInPandas(grow, f"`{route}` {kind}, _forest string"), "forests")
        large = [r[0] for r in sizes.where(F.col("_d") > CELLS).select(self.route).collect()]
        self.large = {r: fit_regression(rows.where(F.col(self.route) == r), columns, "_y", "_large", "gbt") for r in large}
        return self

    def _bins(self) -> Column:
        below = lambda c: lambda t: t <= F.col(c)
        return F.array(*[F.size(F.filter(f"_c{i}", below(c))) for i, c in enumerate(self.columns)])

    def _binned(self, rows: DataFrame) -> DataFrame:
        """Rows of routes with trees, and the bins of their columns."""
        return rows.join(self.cuts, self.route).withColumn("_bins", self._bins()).drop(*[f"_c{i}" for i in range(len(self.columns))])

    def transform(self, df: DataFrame, output: str) -> DataFrame:
        import json

        kind, route = df.schema[self.route].dataType.simpleString(), self.route

        def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({route: [], "_bins": [], "_tree": []}, dtype=object)
            bins, (first, *others) = np.array(left["_bins"].to_list()), json.loads(right["_forest"].iloc[0])
            return pd.DataFrame({route: left[route], "_bins": left["_bins"], "_tree": _leaves(bins, first) + 0.1 * sum(_leaves(bins, t) for t in others)})

        # rows don't go to Python: each route's bins that occur are scored, and met by (route, bins)
        with_bins = df.join(self.cuts, self.route, "left")
        with_bins = with_bins.withColumn("_bins", F.when(F.col("_c0").isNotNull(), self._bins())).drop(*[f"_c{i}" for i in range(len(self.columns))])
        asked = self._binned(df.select(self.route, *self.columns)).select(self.route, "_bins").distinct()
        block = F.pmod(F.xxhash64("_bins"), F.lit(16)).alias("_block")
        trees = self.forests.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
        values = cut(asked.select(self.route, "_bins", block).groupBy(self.route, "_block").cogroup(trees.groupBy(self.route, "_block")).applyInPandas(score, f"`{route}` {kind}, _bins array<int>, _tree double"), "scored")
        out = with_bins.join(values, [self.route, "_bins"], "left").join(self.ridges, self.route, "left")
        linear = sum((F.col("_beta")[i + 1] * F.col(c) for i, c in enumerate(self.columns)), F.col("_beta")[0])
        out = out.withColumn(output, F.coalesce("_tree", linear, F.lit(0.0))).drop("_bins", "_tree", "_beta")
        if self.large:
            parts = [m.transform(out.where(F.col(self.route) == r)).withColumn(output, F.col("_large")).drop("_large") for r, m in self.large.items()]
            out = out.where(F.col(self.route).isNull() | ~F.col(self.route).isin(*self.large))
            for part in parts:
                out = out.unionByName(part)
        return out


@dataclass
class HybridModel:
    """Weighted recipe trees, then shrunk compound bias, then one expert per route on process deltas (ridge for few rows)."""

    recipe: list[str]
    process: list[str]
    label: str
    compound: str
    cluster: str
    route: str
    weight: str
    min_rows: int = 30

    def fit(self, train: DataFrame) -> HybridModel:
        from .aggs import apply_bias, shrunk_bias

        self.surface = fit_regression(train, self.recipe, self.label, "stage0", "gbt", self.weight)
        # written: what follows reads these several times, and would walk through all trees each time
        used = dict.fromkeys([self.compound, self.cluster, self.route, self.weight, *self.process, self.label, "stage0"])
        scored = self.surface.transform(train).select(*used)
        rows = cut(scored, "surface")
        biases = shrunk_bias(rows.withColumn("_r", F.col(self.label) - F.col("stage0")), self.compound, self.cluster, "_r", self.weight)
        self.biases = cut(biases, "biases")
        rows = apply_bias(rows, self.biases, self.compound, self.cluster, "stage1", within=True)
        self.means = cut(train.groupBy(self.route).agg(*[F.avg(c).alias(f"_m_{c}") for c in self.process]), "means")
        rest = (F.col(self.label) - F.col("stage0") - F.col("stage1")).alias("_rest")
        rows = cut(self._deltas(rows).select(self.route, *[f"delta_{c}" for c in self.process], rest), "rest")
        self.experts = RouteExperts(self.route, [f"delta_{c}" for c in self.process], "_rest", self.min_rows).fit(rows)
        return self

    def _deltas(self, df: DataFrame) -> DataFrame:
        out = df.join(self.means, self.route, "left")
        return out.withColumns({f"delta_{c}": F.coalesce(F.col(c) - F.col(f"_m_{c}"), F.lit(0.0)) for c in self.process}).drop(*[f"_m_{c}" for c in self.process])

    def transform(self, df: DataFrame) -> DataFrame:
        from .aggs import apply_bias

        rows = self._deltas(apply_bias(self.surface.transform(df), self.biases, self.compound, self.cluster, "stage1", within=True))
        out = self.experts.transform(rows, "stage2")
        return out.withColumn("prediction", F.col("stage0") + F.col("stage1") + F.col("stage2")).drop(*[f"delta_{c}" for c in self.process])


def nnls(a: np.ndarray, b: np.ndarray, reg: float = 1e-3, steps: int = 500) -> np.ndarray:
    """Non-negative ridge for normal equations of a few columns, by coordinate descent."""
    a = a + reg * np.eye(len(a))
    x = np.zeros(len(b))
    for _ in range(steps):
        old = x.copy()
        for i in range(len(x)):
            x[i] = max(0.0, x[i] + (b[i] - a[i] @ x) / a[i, i])
        if np.abs(x - old).max() < 1e-10:
            break
    return x


@dataclass
class ExpertSubsystem:
    """One expert per group of features, combined with non-negative weights that are fitted on out-of-fold predictions."""

    groups: Mapping[str, list[str]]
    label: str
    fold: str
    kind: str = "gbt"
    positive: bool = True

    def fit(self, train: DataFrame) -> ExpertSubsystem:
        self.models = {g: fit_regression(train, c, self.label, f"expert_{g}", self.kind) for g, c in self.groups.items()}
        parts = []
        for (k,) in train.select(self.fold).distinct().collect():
            rest, own = train.where(F.col(self.fold) != k), train.where(F.col(self.fold) == k)
            for g, c in self.groups.items():
                own = fit_regression(rest, c, self.label, f"expert_{g}", self.kind).transform(own)
            parts.append(own)
        oof = parts[0]
        for x in parts[1:]:
            oof = oof.unionByName(x)
        names = [f"expert_{g}" for g in self.groups]
        products = [F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate([*names, self.label])]
        row = oof.where(F.col(self.label).isNotNull()).agg(*products).first()
        a = np.array([[row[f"s{i}_{j}"] or 0.0 for j in range(len(names))] for i in range(len(names))])
        b = np.array([row[f"s{i}_{len(names)}"] or 0.0 for i in range(len(names))])
        self.weights = nnls(a, b) if self.positive else np.linalg.solve(a + 1e-3 * np.eye(len(a)), b)
        return self

    def transform(self, df: DataFrame, output: str = "subsystem") -> DataFrame:
        for m in self.models.values():
            df = m.transform(df)
        return df.withColumn(output, sum((float(w) * F.col(f"expert_{g}") for g, w in zip(self.groups, self.weights, strict=True)), F.lit(0.0)))


def ablation(train: DataFrame, test: DataFrame, variants: Mapping[str, Mapping[str, list[str]]], label: str, fold: str, kind: str = "ridge") -> DataFrame:
    """Metrics on test of an expert subsystem for each variant of feature groups."""
    out = None
    for name, groups in variants.items():
        scored = ExpertSubsystem(groups, label, fold, kind).fit(train).transform(test)
        row = regression_metrics(scored, label, "subsystem").withColumn("variant", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@dataclass
class EnergyModel:
    """A global baseline and an expert per branch on its residual (branches with enough rows), clipped."""

    columns: list[str]
    label: str
    branch: str
    min_rows: int = 10
    low: float = 10.0
    high: float = 120.0
    kind: str = "gbt"

    def fit(self, train: DataFrame) -> EnergyModel:
        self.base = fit_regression(train, self.columns, self.label, "base", self.kind)
        rows = self.base.transform(train).withColumn("_rest", F.col(self.label) - F.col("base"))
        counts = {r[0]: r[1] for r in rows.groupBy(self.branch).count().collect()}
        self.experts = {b: fit_regression(rows.where(F.col(self.branch) == b), self.columns, "_rest", "branch_part", self.kind) for b, n in counts.items() if b is not None and n >= self.min_rows}
        return self

    def transform(self, df: DataFrame, weight_ton: str | None = None) -> DataFrame:
        rows = self.base.transform(df)
        parts = [m.transform(rows.where(F.col(self.branch) == b)) for b, m in self.experts.items()]
        rest = F.col(self.branch).isNull() | ~F.col(self.branch).isin(*self.experts) if self.experts else F.lit(True)
        parts.append(rows.where(rest).withColumn("branch_part", F.lit(0.0)))
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        out = out.withColumn("energy_pred", F.greatest(F.lit(self.low), F.least(F.lit(self.high), F.col("base") + F.col("branch_part"))))
        return out.withColumn("pred_per_ton", F.col("energy_pred") / F.nullif(F.col(weight_ton), F.lit(0.0))) if weight_ton else out


@dataclass
class HighEnergyModel:
    """A detector of high energy with balanced classes, and a corrector of its residual, clipped to percentiles 5 and 95."""

    columns: list[str]
    flag: str
    residual: str
    min_rows: int = 30

    def fit(self, train: DataFrame) -> HighEnergyModel:
        share = train.agg(F.avg(F.col(self.flag).cast("double"))).first()[0] or 0.0
        weight = F.when(F.col(self.flag), 0.5 / max(share, 1e-6)).otherwise(0.5 / max(1 - share, 1e-6))
        rows = train.withColumns({"_y": F.col(self.flag).cast("double"), "_w": weight})
        learner = GBTClassifier(featuresCol="detector__features", labelCol="_label", predictionCol="detected", maxIter=20, maxDepth=3, seed=42)
        learner = learner.setRawPredictionCol("_raw").setProbabilityCol("_prob")
        self.detector = fit_trees(rows, self.columns, "_y", learner, "detector__features", "_w", classes=True)
        high = train.where(F.col(self.flag))
        row = percentiles(high, [], {"_p": self.residual}, [0.05, 0.95], [F.count("*").alias("_n")]).select("_n", F.col("_p")[0], F.col("_p")[1]).first()
        self.limits = row[1:]
        self.corrector = fit_regression(high, self.columns, self.residual, "correction", "gbt") if row[0] >= self.min_rows else None
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = _drop_work(self.detector.transform(df)).withColumn("high_probability", vector_to_array("_prob")[1]).drop("detector__features", "_raw", "_prob")
        if self.corrector is None:
            return out.withColumn("correction", F.lit(0.0))
        out = self.corrector.transform(out)
        return out.withColumn("correction", F.when(F.col("detected") == 1, F.greatest(F.lit(self.limits[0]), F.least(F.lit(self.limits[1]), F.col("correction")))).otherwise(0.0))


# ---- isolation forest -------------------------------------------------------------------------------------------------


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int) -> list:
    """A node [feature, cut, left, right], or a leaf [size]."""
    spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(x.shape[1])
    usable = np.flatnonzero(spread > 0)
    if depth >= limit or len(x) <= 1 or not len(usable):
        return [float(len(x))]
    f = int(rng.choice(usable))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < cut
    return [f, cut, _grow(x[left], rng, depth + 1, limit), _grow(x[~left], rng, depth + 1, limit)]


def _expected(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _depths(x: np.ndarray, tree: list, depth: int = 0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), depth + _expected(tree[0]))
    left = x[:, int(tree[0])] < tree[1]
    out = np.empty(len(x))
    out[left] = _depths(x[left], tree[2], depth + 1)
    out[~left] = _depths(x[~left], tree[3], depth + 1)
    return out


def isolation_forest(train: DataFrame, df: DataFrame, columns: list[str], by: str, key: str, contamination: float = 0.05, trees: int = 50, sample: int = 256, min_rows: int = 10, seed: int = 42, block: int = 50_000) -> DataFrame:
    """anomaly_score and is_outlier of each row of df, by forests fitted on train for each group.

    Every tree of a group is fitted on the `sample` training rows with the least hash for that tree: a group of any size
    gives at most `sample` rows to a task. The forests have at most groups x trees small trees; a task scores
    about `block` rows of a group with its forest. Groups with too few training rows have null scores. Missing values count as 0.
    """
    import json

    from .joins import first_rows
    from .splits import uniform

    rows = doubles(train, columns).na.fill(0.0, columns).where(F.col(by).isNotNull())
    enough = rows.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows)
    dealt = rows.join(enough, by).select(by, key, *columns, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    # thin out before ranking: three times the sample is kept on average, never less than all of a small group
    n_of = enough.select(by, F.col("_n"))
    draw = uniform(F.col(key), F.col("tree"), seed=seed)
    dealt = dealt.join(n_of, by).withColumn("_u", draw).where(F.col("_u") <= 3.0 * sample / F.col("_n")).drop("_n")
    picked = first_rows(dealt, [by, "tree"], [F.col("_u"), F.col(key)], sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(key)[columns].to_numpy(float)
        number = int(pdf["tree"].iloc[0])
        made = _grow(x, np.random.default_rng(seed + number), 0, int(np.ceil(np.log2(max(2, sample)))))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "size": [len(x)], "made": [json.dumps(made)]})

    kind = train.schema[by].dataType.simpleString()
    grown = picked.groupBy(by, "tree").applyInPandas(grow, f"`{by}` {kind}, size long, made string")
    forests = grown.groupBy(by).agg(F.max("size").alias("_size"), F.sort_array(F.collect_list("made")).alias("_forest"))
    # a forest goes along with a block of its group's rows, not with each row
    known = cut(forests, "forests")
    blocks = doubles(df, columns).groupBy(by).agg(F.ceil(F.count("*") / block).alias("_blocks"))
    each = known.join(blocks, by).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")
    rows = doubles(df, columns).join(F.broadcast(blocks.join(known.select(by), by)), by, "left")
    rows = rows.withColumn("_block", F.when(F.col("_blocks").isNotNull(), F.pmod(F.xxhash64(key), "_blocks"))).drop("_blocks")
    without = rows.where("_block is null").drop("_block").withColumn("anomaly_score", F.lit(None).cast("double"))
    names = [c for c in rows.columns if c != "_block"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = left.select(names)
        made = right.to_pylist()
        if not made or not out.num_rows:
            return out.slice(0, 0).append_column("anomaly_score", pa.array([], pa.float64()))
        x = np.column_stack([out[c].fill_null(0.0).to_numpy() for c in columns])
        depth = np.mean([_depths(x, json.loads(t)) for t in made[0]["_forest"]], axis=0)
        return out.append_column("anomaly_score", pa.array(2 ** (-depth / max(_expected(float(made[0]["_size"])), 1e-9))))

    scored = rows.where("_block is not null").groupBy(by, "_block").cogroup(each.groupBy(by, "_block")).applyInArrow(score, without.schema)
    scored = cut(scored.unionByName(without), "scored")
    limits = percentiles(scored, [by], {"_limit": "anomaly_score"}, [1 - contamination]).select(by, F.col("_limit")[0].alias("_limit"))
    return scored.join(limits, by, "left").withColumn("is_outlier", F.coalesce(F.col("anomaly_score") > F.col("_limit"), F.lit(False))).drop("_limit")


# ---- clusters, comparison, importance ---------------------------------------------------------------------------------


def cluster_compounds(df: DataFrame, compound: str, columns: list[str], k: int = 5, seed: int = 42) -> tuple[DataFrame, float | None]:
    """Cluster of each compound by its scaled fingerprint, and the silhouette."""
    rows = cut(fingerprint(df, compound, columns), "fingerprints")  # a row per compound, which every step of the fit reads
    made = preprocess([f"{c}_median" for c in columns], "fp").fit(rows).transform(rows)
    n = made.count()
    model = KMeans(featuresCol="fp", predictionCol="cluster", k=max(2, min(k, n)), seed=seed).fit(made) if n > 2 else None
    out = model.transform(made) if model else made.withColumn("cluster", F.lit(0))
    quality = ClusteringEvaluator(featuresCol="fp", predictionCol="cluster").evaluate(out) if model and out.select("cluster").distinct().count() > 1 else None
    return _drop_work(out).drop("fp"), quality


class CrossValidator(tuning.CrossValidator):
    """pyspark.ml's, but with given folds as plain filters, where its own asks Python about each row of each fold."""

    def _kFold(self, dataset: DataFrame) -> list[tuple[DataFrame, DataFrame]]:  # noqa: N802
        fold = F.col(self.getFoldCol())
        return [(dataset.where(fold != k), dataset.where(fold == k)) for k in range(self.getNumFolds())]


class CellTrees(Estimator):
    """fit_trees() as an estimator for CrossValidator."""

    def __init__(self, columns: list[str], learner: GBTRegressor):
        super().__init__()
        self.columns, self.learner = columns, learner

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        return fit_trees(dataset, self.columns, "label", self.learner.copy(), self.learner.getFeaturesCol())


def compare_models_cv(df: DataFrame, columns: list[str], label: str, fold: str, seed: int = 42) -> dict[str, float]:
    """Cross-validated RMSE of linear, forest and boosted models over small grids, with given folds.

    Linear models and forests make few passes over all rows, in as many tasks as the rows ask for, CV_ROWS each, as each task
    sends a result to the driver. Boosted trees make some hundred, over the cells of a fold's rows (see fit_trees())."""
    own = {f"c{i}": F.col(c).cast("double") for i, c in enumerate(columns)}
    rows = preprocess(columns, "x").fit(df).transform(df.where(F.col(label).isNotNull()))
    rows = cut(rows.select("x", F.col(label).alias("label"), F.col(fold).cast("int").alias("fold"), *[v.alias(c) for c, v in own.items()]), "cv")
    n, last = rows.agg(F.count("*"), F.max("fold")).first()
    rows = rows.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // CV_ROWS))).cache()
    folds = last + 1
    learners = {
        "linear": (m := LinearRegression(featuresCol="x"), ParamGridBuilder().addGrid(m.regParam, [0.1, 1.0]).build()),
        "forest": (f := RandomForestRegressor(featuresCol="x", seed=seed, numTrees=20), ParamGridBuilder().addGrid(f.maxDepth, [4]).build()),
        "boosted": (CellTrees(list(own), GBTRegressor(featuresCol="bins", seed=seed, maxIter=20, maxDepth=3)), ParamGridBuilder().build()),
    }
    out = {}
    for name, (learner, grid) in learners.items():
        cv = CrossValidator(estimator=learner, estimatorParamMaps=grid, evaluator=RegressionEvaluator(metricName="rmse"), numFolds=folds, foldCol="fold")
        out[name] = min(cv.fit(rows).avgMetrics)
    rows.unpersist()
    return out


def stacked(train: DataFrame, df: DataFrame, columns: list[str], label: str, fold: str, offset: str | None = None) -> DataFrame:
    """Ridge and trees, stacked by ridge on their out-of-fold predictions; `offset` is added back to a residual label."""
    groups = {"ridge": columns, "gbt": columns}
    parts = []
    for (k,) in train.select(fold).distinct().collect():
        rest, own = train.where(F.col(fold) != k), train.where(F.col(fold) == k)
        for g in groups:
            own = fit_regression(rest, columns, label, f"base_{g}", g).transform(own)
        parts.append(own)
    oof = parts[0]
    for x in parts[1:]:
        oof = oof.unionByName(x)
    top = fit_regression(oof, [f"base_{g}" for g in groups], label, "stack")
    out = df
    for g in groups:
        out = fit_regression(train, columns, label, f"base_{g}", g).transform(out)
    out = top.transform(out)
    return out.withColumn("stack", F.col("stack") + F.col(offset)) if offset else out


def permutation_importance(model, df: DataFrame, columns: list[str], label: str, prediction: str, key: str, seed: int = 0) -> DataFrame:
    """Per feature the rise of MAE and fall of R2 when it is taken from another row.

    Rows are matched in two orders, by key and by a hash of it, within 256 blocks by that hash, so that no window holds
    the whole table."""
    from .splits import uniform

    base = regression_metrics(model.transform(df), label, prediction).first()
    block = F.floor(uniform(F.col(key), seed=seed + 1) * 256).cast("int")
    rows = df.withColumn("_b", block)
    w = Window.partitionBy("_b")
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(key)))
    other = rows.select("_b", *[F.col(c).alias(f"_p_{c}") for c in columns], F.row_number().over(w.orderBy(uniform(F.col(key), seed=seed), key)).alias("_i"))
    both = numbered.join(other, ["_b", "_i"])
    out = None
    for c in columns:
        scored = model.transform(both.withColumn(c, F.col(f"_p_{c}")))
        row = regression_metrics(scored, label, prediction).select(F.lit(c).alias("feature"), (F.col("mae") - base["mae"]).alias("delta_mae"), (F.lit(base["r2"]) - F.col("r2")).alias("delta_r2"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("consistent", F.signum("delta_mae") == F.signum("delta_r2"))


def guidance(df: DataFrame, columns: list[str], label: str, k: int = 5) -> DataFrame:
    """The k features of largest absolute rank correlation, with direction and percentiles 10, 50, 90."""
    from .aggs import counted_spearman, long
    from .quantiles import percentiles

    rows = long(df, [label], columns).where(f"value is not null and {label} is not null")
    pairs = cut(rows.groupBy("feature", "value", label).agg(F.count("*").alias("_c")), "pairs")  # df is read once
    rho = counted_spearman(pairs, ["feature"], "value", label, "_c")
    ps = percentiles(pairs, ["feature"], {"_p": "value"}, (0.1, 0.5, 0.9), count="_c")
    out = rho.join(ps, "feature").select("feature", "rho", *[F.col("_p")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))])
    text = F.when(F.col("rho") > 0, "higher raises the label").when(F.col("rho") < 0, "higher lowers the label").otherwise("no direction")
    return out.withColumn("direction", text).orderBy(F.desc(F.abs("rho")), "feature").limit(k)


# ---- neighbours and confidence ----------------------------------------------------------------------------------------


#: Pivots of a nearest-neighbour search: about the root of the reference's size, within these.
PIVOTS = (16, 1024)


def _to_pivots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((0, len(pivots))), *(np.linalg.norm(points[at : at + 128, None] - pivots[None], axis=2) for at in range(0, len(points), 128))])


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def pivot_visits(own: DataFrame, counted: DataFrame, vector: str, k: int, block: int = 20_000) -> tuple[DataFrame, DataFrame] | None:
    """own: distinct vectors; counted: distinct reference vectors, n. The reference by cells, each vector in that of its nearest
    pivot (vector, n, cell, d, bin); and for each vector of own the cells that may hold one of its k nearest (vector, bin, cells,
    dqs, reach). A bin is cells beside each other with about `block` vectors, so that a vector goes along once for a bin and
    not for each cell. None without a reference.

    Pivots are the reference vectors of least hash. A cell tells the driver its least and greatest distance from its pivot
    and its k nearest ones; from these a vector knows a distance within which it has k neighbours, and which cells lie
    beyond it, by the triangle inequality."""
    low, high = PIVOTS
    marks = counted.select(vector).orderBy(F.xxhash64(vector), vector).limit(min(high, max(low, math.isqrt(counted.count())))).collect()
    if not marks:
        return None
    pivots = np.array([r[0] for r in marks], float)
    kind = own.schema[vector].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (x for x in batches if len(x)):
            d = _to_pivots(_matrix(batch[vector]), pivots)
            cell = d.argmin(axis=1)
            yield pd.DataFrame({vector: batch[vector], "n": batch["n"], "cell": cell, "d": d[np.arange(len(d)), cell]})

    # cells in order of their pivots along the axis on which these differ most
    middle = pivots - pivots.mean(axis=0)
    along = np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")
    placed = cut(counted.select(vector, "n").mapInPandas(place, f"`{vector}` {kind}, n long, cell int, d double"), "placed")
    first = placed.select("cell", "d", "n").withColumn("rn", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).where(F.col("rn") <= k)
    close, far, known = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), np.full((len(pivots), k), np.inf)
    sizes = np.zeros(len(pivots), np.int64)
    for r in placed.groupBy("cell").agg(F.min("d").alias("a"), F.max("d").alias("b"), F.count("*").alias("c")).collect():
        close[r.cell], far[r.cell], sizes[r.cell] = r.a, r.b, r.c
    bin_of = np.empty(len(pivots), np.int64)
    bin_of[along] = (np.cumsum(sizes[along]) - sizes[along]) // block
    for r in first.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("d", "n"))).alias("x")).collect():
        own_k = np.repeat([x.d for x in r.x], [min(x.n, k) for x in r.x])[:k]
        known[r.cell, : len(own_k)] = own_k

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (x for x in batches if len(x)):
            d = _to_pivots(_matrix(batch[vector]), pivots)
            for at in range(0, len(d), 128):
                part = d[at : at + 128]
                upper = (part[:, :, None] + known[None]).reshape(len(part), -1)
                reach = np.partition(upper, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-12
                row, cell = np.nonzero(np.maximum(part - far, close - part) <= reach[:, None])
                order = np.lexsort((bin_of[cell], row))
                row, cell = row[order], cell[order]
                first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(bin_of[cell]) != 0)]) if len(row) else np.empty(0, np.int64)
                cells, dqs = np.split(cell, first[1:]), np.split(part[row, cell], first[1:])
                r = row[first]
                yield pd.DataFrame({vector: batch[vector].to_numpy()[at + r], "bin": bin_of[cell[first]], "cells": cells[: len(r)], "dqs": dqs[: len(r)], "reach": reach[r]})

    binned = placed.withColumn("bin", F.lit([int(x) for x in bin_of])[F.col("cell")].cast("long"))
    return binned, cut(own.select(vector).mapInPandas(visit, f"`{vector}` {kind}, bin long, cells array<int>, dqs array<double>, reach double"), "visits")


def _nearest(rows: DataFrame, reference: DataFrame, vector: str, k: int, block: int) -> DataFrame:
    """Distances, in order, of each distinct vector of rows to its k nearest vectors of reference, as vector, near. A vector
    meets the cells of pivot_visits() only, and of these the ring that its distance to the pivot leaves. Bins and those who visit
    them are cut into blocks of about `block` vectors, two of which meet in a task; what a vector keeps of a block is k
    numbers. Copies in the reference count as often as they occur."""
    spark = rows.sparkSession
    own, counted = cut(rows.select(vector).distinct(), "vectors"), cut(reference.groupBy(vector).agg(F.count("*").alias("n")), "reference")
    kind = rows.schema[vector].dataType.simpleString()
    found = pivot_visits(own, counted, vector, k, block)
    if found is None:
        return spark.createDataFrame([], f"`{vector}` {kind}, near array<double>")
    placed, asked = found
    # who visits a bin is cut finer, so that few bins are work for all cores
    parts = F.greatest(F.ceil(4 * F.count("*") / block), F.least(F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))), F.ceil(F.count("*") / 500)))
    sizes = placed.groupBy("bin").agg(F.ceil(F.count("*") / block).alias("nb")).join(asked.groupBy("bin").agg(parts.alias("na")), "bin")
    blocks = F.broadcast(sizes)  # a row for each bin, no more than pivots
    place = lambda n: F.pmod(F.xxhash64(vector), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(blocks, "bin").withColumn("a", place("na")).withColumn("b", each("nb")).drop("na", "nb")
    right = placed.join(blocks, "bin").withColumn("b", place("nb")).withColumn("a", each("na")).drop("na", "nb")

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({vector: [], "near": []}, dtype=object)
        points, reach = _matrix(x[vector]), x["reach"].to_numpy()
        row, cells, dqs = np.repeat(np.arange(len(x)), x["cells"].map(len)), np.concatenate(x["cells"].to_list()), np.concatenate(x["dqs"].to_list())
        order = np.lexsort((dqs, cells))
        row, cells, dqs = row[order], cells[order], dqs[order]
        best = np.full((len(x), k), np.inf)
        for cell, those in y.sort_values("d").groupby("cell"):
            low, high = np.searchsorted(cells, cell), np.searchsorted(cells, cell, side="right")
            times = np.minimum(those["n"].to_numpy(), k)
            ref, d = np.repeat(_matrix(those[vector]), times, axis=0), np.repeat(those["d"].to_numpy(), times)
            for at in range(low, high, 256):
                own_rows, dq = row[at : min(at + 256, high)], dqs[at : min(at + 256, high)]
                part, ends = points[own_rows], (dq - reach[own_rows], dq + reach[own_rows])
                ring = ref[np.searchsorted(d, ends[0].min() - 1e-9) : np.searchsorted(d, ends[1].max() + 1e-9, side="right")]
                m = min(k, len(ring))
                if not m:
                    continue
                square = (part**2).sum(axis=1)[:, None] + (ring**2).sum(axis=1) - 2 * part @ ring.T
                nearest = ring[np.argpartition(square, m - 1, axis=1)[:, :m]]
                found = np.linalg.norm(nearest - part[:, None], axis=2)
                best[own_rows] = np.sort(np.concatenate([best[own_rows], found], axis=1), axis=1)[:, :k]
        return pd.DataFrame({vector: x[vector].to_numpy(), "near": [b[b < np.inf] for b in best]})

    met = left.groupBy("bin", "a", "b").cogroup(right.groupBy("bin", "a", "b")).applyInPandas(compare, f"`{vector}` {kind}, near array<double>")
    return met.groupBy(vector).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def applicability(df: DataFrame, train: DataFrame, key: str, vector: str, k: int = 5, block: int = 20_000) -> DataFrame:
    """ML17: mean distance to the k nearest training vectors, and how it compares with the training set's own percentiles.

    Both sides may be of any size: they meet in cells around pivots, those that can hold neighbours only. A null vector, and any where there is no training vector, has a
    null distance and is OUT_OF_DOMAIN; a training set of one vector has a distance of 0 to itself."""
    rows, known = (x.select(vector).where(F.col(vector).isNotNull()) for x in (df, train))
    near = cut(_nearest(rows.unionByName(known), known, vector, k + 1, block), "near")
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part)
    others = F.slice("near", 2, k)
    spread = known.groupBy(vector).agg(F.count("*").alias("n")).join(near, vector).select("n", F.when(F.size(others) > 0, mean(others)).otherwise(0.0).alias("d"))
    own = spread.agg(F.percentile("d", F.array(*map(F.lit, (0.9, 0.95, 0.99))), F.col("n")).alias("p")).first()[0] or [None] * 3
    d = F.col("knn_distance")
    out = df.join(near.select(vector, mean(F.slice("near", 1, k)).alias("knn_distance")), vector, "left").select(*df.columns, "knn_distance")
    low, middle, high = (F.lit(x).cast("double") for x in own)
    return out.withColumn("reliability", F.when(d <= low, "HIGH").when(d <= middle, "MEDIUM").when(d <= high, "LOW").otherwise("OUT_OF_DOMAIN"))


def out_of_range(df: DataFrame, profile: DataFrame, key: str, columns: list[str], k: int = 8) -> DataFrame:
    """Features beyond the profile's percentiles 1 and 99 (profile: feature, p01, p99): how many, and the k furthest."""
    from .aggs import long

    rows = long(df, [key], columns).join(F.broadcast(profile.where(F.col("feature").isin(*columns)).select("feature", "p01", "p99")), "feature")
    width = F.nullif(F.col("p99") - F.col("p01"), F.lit(0.0))
    off = F.greatest(F.col("p01") - F.col("value"), F.col("value") - F.col("p99")) / width
    hit = rows.withColumn("_o", off).where(F.col("_o") > 0)
    names = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_o")).alias("o"), "feature"))), 1, k), lambda x: x["feature"])
    found = hit.groupBy(key).agg(F.count("*").alias("n_out"), F.concat_ws(", ", names).alias("out_features"))
    return df.select(key).join(found, key, "left").select(key, F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("out_features", F.lit("")).alias("out_features"))


def confidence(df: DataFrame, train: DataFrame, columns: list[str], spread: str, density: str) -> DataFrame:
    """0.4 exp(-0.3 Mahalanobis) + 0.3 density + 0.3 (1 - spread), and Green, Yellow or Red. Means and covariances are one
    row of aggregates."""
    row = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns)]).first()
    cov = np.array([[row[f"c{i}_{j}"] or 0.0 for j in range(len(columns))] for i in range(len(columns))])
    inverse = np.linalg.pinv(cov + 1e-6 * np.eye(len(columns)))
    d = [F.coalesce(F.col(c), F.lit(row[f"m{i}"])) - F.lit(row[f"m{i}"] or 0.0) for i, c in enumerate(columns)]
    square = sum((float(inverse[i, j]) * d[i] * d[j] for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    out = df.withColumn("mahalanobis", F.sqrt(F.greatest(square, F.lit(0.0))))
    value = 0.4 * F.exp(-0.3 * F.col("mahalanobis")) + 0.3 * F.coalesce(F.col(density), F.lit(0.0)) + 0.3 * (1 - F.least(F.lit(1.0), F.coalesce(F.col(spread), F.lit(1.0))))
    return out.withColumn("confidence", value).withColumn("light", F.when(value >= 0.7, "Green").when(value >= 0.4, "Yellow").otherwise("Red"))


def nearest_groups(means: DataFrame, group: str, features: list[str], k: int, most: int = 10_000) -> DataFrame:
    """The k nearest groups of each (itself counted, ties by name): `group`, near, distance. means has a row per group, `most` at
    most: the list goes along with each of them. More are refused: cut them by family first."""
    packed = means.agg(F.collect_list(F.struct(F.col(group).alias("near"), F.array(*features).alias("at"))).alias("_all"), F.count("*").alias("_n"))
    if (packed.first()["_n"] or 0) > most:
        raise ValueError(f"more than {most} groups")
    here = F.array(*features)
    far = lambda x: F.sqrt(F.aggregate(F.zip_with(here, x["at"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    ranked = F.slice(F.array_sort(F.transform("_all", lambda x: F.struct(far(x).alias("distance"), x["near"].alias("near")))), 1, k)
    out = means.join(F.broadcast(packed)).select(group, F.explode(ranked).alias("x"))
    return out.select(group, "x.near", "x.distance")


def local_prediction(df: DataFrame, train: DataFrame, compound: str, neighbours: DataFrame, columns: list[str], label: str, reg: float = 1.0) -> DataFrame:
    """Predictions of a ridge per compound on the rows of its nearest compounds, weighted by exp(-1.5 distance).

    neighbours: compound, near, distance (a few rows per compound). The normal equations are sums by compound, so that a
    group gives one short row to its solver."""
    rows = doubles(train, [*columns, label]).na.fill(0.0, columns).where(F.col(label).isNotNull())
    joined = rows.withColumnRenamed(compound, "near").join(neighbours.select(compound, "near", F.exp(-1.5 * F.col("distance")).alias("_w")), "near")
    terms = [F.lit(1.0), *map(F.col, columns)]
    sums = [F.sum(F.col("_w") * terms[i] * terms[j]).alias(f"x{i}_{j}") for i in range(len(terms)) for j in range(i, len(terms))]
    sums += [F.sum(F.col("_w") * t * F.col(label)).alias(f"y{i}") for i, t in enumerate(terms)]
    normal = joined.groupBy(compound).agg(*sums)
    n = len(terms)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            betas = []
            for r in batch.to_dict("records"):
                a = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
                betas.append(np.linalg.solve(a + np.diag([1e-9, *[reg] * (n - 1)]), np.array([r[f"y{i}"] for i in range(n)])))
            yield pd.DataFrame({compound: batch[compound], "beta": betas})

    kind = train.schema[compound].dataType.simpleString()
    betas = normal.mapInPandas(solve, f"`{compound}` {kind}, beta array<double>")
    out = doubles(df, columns).na.fill(0.0, columns).join(betas, compound, "left")
    return out.withColumn("local_prediction", sum((F.col("beta")[i] * t for i, t in enumerate(terms)), F.lit(0.0))).drop("beta")


#: Points of similar_recipes() up to which they are broadcast.
POINTS = 500_000


def similar_recipes(df: DataFrame, history: DataFrame, recipe: str, keys: list[str], columns: list[str], mixer: str, k: int = 5, band: tuple[str, float] | None = None) -> DataFrame:
    """ML21: the k nearest recipes of the same keys (system, route) by mean relative distance, the same mixer preferred.
    history has one row per recipe and mixer. band: a column and how far apart recipes may be in it; it parts large keys
    into cells of that width, and each recipe meets its own cell and the two beside it.

    Recipes of equal keys, mixer and columns are one point: points are compared, not recipes, and a point brings as many of its
    least recipes as can be wanted. The cost grows with the pairs of different points of a key and band."""
    from .joins import first_rows

    own = history.groupBy(recipe).count().agg(F.max("count")).first()[0] or 0
    most = k + own  # a recipe doesn't count for itself
    point = list(dict.fromkeys([*keys, mixer, *columns, *([band[0]] if band else [])]))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = df.select(*point).distinct().repartition(parts, *point)  # few rows that make many pairs
    known = first_rows(history.select(*point, recipe), point, [F.col(recipe)], most).groupBy(*point).agg(F.array_sort(F.collect_list(recipe)).alias("_others"))
    meet = list(keys)
    if band:
        column, width = band
        cell = F.floor(F.col(column) / width)
        asked = asked.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
        known, meet = known.withColumn("_cell", cell), [*keys, "_cell"]

    rest = [c for c in point if c not in keys]
    side = cut(known.select(*meet, "_others", *[F.col(c).alias(f"_{c}") for c in rest]), "points")
    joined = asked.join(F.broadcast(side) if side.count() <= POINTS else side, meet)
    if band:
        joined = joined.where(F.abs(F.col(band[0]) - F.col(f"_{band[0]}")) <= band[1])
    gap = sum((F.abs(F.col(c) - F.col(f"_{c}")) / F.greatest(F.abs(c), F.lit(1.0)) for c in columns), F.lit(0.0)) / len(columns)
    joined = joined.withColumns({"distance": gap, "_far": (F.col(f"_{mixer}") != F.col(mixer)).cast("int")})
    order = [F.col("_far"), F.col("distance")]
    near = first_rows(joined, point, [*order, F.col("_others")[0]], most).select(*point, "_far", "distance", F.explode("_others").alias("_other"))
    near = first_rows(near, point, [*order, F.col("_other")], most).withColumnsRenamed({c: f"_at_{c}" for c in point})
    near = cut(near, "near")  # written, its size is known to the join
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in point]
    found = df.join(near, same).where(F.col(recipe) != F.col("_other"))
    ranked = first_rows(found, [recipe, mixer], [*order, F.col("_other")], k)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("distance", "_other"))), lambda x: x["_other"]), ", ")
    return ranked.groupBy(recipe, mixer).agg(names.alias("similar"), F.avg("distance").alias("mean_distance"))


def hard_em(df: DataFrame, group: str, key: str, columns: list[str], label: str, rounds: int = 10) -> DataFrame:
    """Per group the batch whose prediction is nearest to the group's label, refitted until no choice changes."""
    chosen = df.groupBy(group).agg(F.min(key).alias(key))
    for _ in range(rounds):
        own = cut(df.join(chosen, [group, key]).select(*columns, label), "chosen")  # a fit reads it several times
        model = fit_regression(own, columns, label, "_em")
        scored = model.transform(df).withColumn("_off", F.abs(F.col(label) - F.col("_em")))
        new = cut(scored.groupBy(group).agg(F.min(F.struct("_off", key)).alias("_b")).select(group, F.col(f"_b.{key}").alias(key)), "chosen")
        changed = new.join(chosen.withColumnRenamed(key, "_old"), group).where(F.col(key) != F.col("_old")).count()
        chosen = new
        if not changed:
            break
    return chosen


def group_ridge(df: DataFrame, group: str, columns: list[str], label: str, mode: str = "minimax", steps: int = 30, rate: float = 0.1, reg: float = 1e-3) -> np.ndarray:
    """Coefficients (intercept first) of a ridge whose loss per group is its worst batch's ("minimax"), or a softmax-weighted
    mean of its batches' ("attention"). Each step is one aggregate with a gradient as long as the columns; columns should
    be scaled."""
    rows = doubles(df, [*columns, label]).na.fill(0.0, columns).where(F.col(label).isNotNull())
    beta = np.zeros(len(columns) + 1)
    beta[0] = rows.agg(F.avg(label)).first()[0] or 0.0
    terms = [F.lit(1.0), *map(F.col, columns)]
    for _ in range(steps):
        off = sum((float(b) * t for b, t in zip(beta, terms, strict=True)), F.lit(0.0)) - F.col(label)
        scored = rows.withColumn("_e", off)
        if mode == "minimax":
            weight = F.when(F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.abs("_e")))) == 1, 1.0).otherwise(0.0)
        else:
            share = F.exp(-F.least(F.abs("_e"), F.lit(30.0)))
            weight = share / F.sum(share).over(Window.partitionBy(group))
        scored = scored.withColumn("_w", weight)
        row = scored.agg(F.sum("_w").alias("n"), *[F.sum(F.col("_w") * F.col("_e") * t).alias(f"g{i}") for i, t in enumerate(terms)]).first()
        gradient = np.array([row[f"g{i}"] for i in range(len(terms))]) / max(row["n"] or 1.0, 1.0)
        beta -= rate * (gradient + reg * np.concatenate(([0.0], beta[1:])))
    return beta


def score(df: DataFrame, model, calibration: Column | None = None, prediction: str = "prediction") -> DataFrame:
    """Predictions of a stored package and, with a correction, the calibrated value."""
    out = model.transform(df)
    return out.withColumn("calibrated", F.col(prediction) + calibration) if calibration is not None else out


def separated_vs_unified(train: DataFrame, test: DataFrame, system: str, columns: list[str], label: str, kind: str = "ridge") -> DataFrame:
    """Metrics per system and overall of one model per system and of one model for all."""
    whole = fit_regression(train, columns, label, "unified", kind)
    parts = None
    for (s,) in train.select(system).distinct().collect():
        own = fit_regression(train.where(F.col(system) == s), columns, label, "separated", kind).transform(test.where(F.col(system) == s))
        parts = own if parts is None else parts.unionByName(own)
    both = whole.transform(parts)
    out = None
    for name in ("unified", "separated"):
        m = both.rollup(system).agg(F.grouping(system).alias("_g"), *error_aggs(label, name)).withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.withColumn(system, F.when(F.col("_g") == 1, "OVERALL").otherwise(F.col(system))).drop("_g")
