"""Feature engineering: encoding, binning, scaling, selection and principal components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import (
    PCA,
    Bucketizer,
    ChiSqSelector,
    MinMaxScaler,
    Normalizer,
    OneHotEncoder,
    StandardScaler,
    UnivariateFeatureSelector,
    VarianceThresholdSelector,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from custlytics.functions import fixed_values as fixed, labels
from custlytics.operators.cleaning import impute
from custlytics.operators.ordered import ordered_columns
from custlytics.operators.quantiles import as_struct, quantiles
from custlytics.session import reused, stored

PIPELINE_FEATURES = ["age", "income", "credit_score", "years_employed", "num_accounts"]


def label_table(df: DataFrame, column: str) -> DataFrame:
    """(label, place): 0 for the most frequent label, ties in alphabetical order. Nulls are no label."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordered_columns(counted, [], ["-_n", "label"], running={"_place": "row_number"})
    return ranked.select("label", (F.col("_place") - 1).alias("place"))


def label_tables(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, label, place) of several text columns, as :func:`label_table` gives them, counted in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("label")) for c in columns])
    counted = df.select(F.inline(pairs)).filter("label is not null").groupBy("column", "label").agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordered_columns(counted, ["column"], ["-_n", "label"], running={"_place": "row_number"})
    return ranked.select("column", "label", (F.col("_place") - 1).alias("place"))


def _label_tables(df: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """The label table of each column, written once; text columns are counted together."""
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    together = stored(label_tables(df, texts)) if texts else None
    return {c: together.filter(F.col("column") == c).drop("column") if c in texts else stored(label_table(df, c)) for c in columns}


def _indexed(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    for c, table in tables.items():
        index = table.select(F.col("label").alias("_label"), F.col("place").cast("double").alias(f"{c}_indexed"))
        df = df.join(index, F.col(c) == F.col("_label"), "left").drop("_label")
    return df


def string_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_indexed``: 0.0 for the most frequent label, ties in alphabetical order, null for null.

    The labels stay in a table that is joined, however many there are."""
    return _indexed(df, _label_tables(df, columns))


def one_hot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_encoded``: a sparse vector with a 1 at the label's index; the last index is all zeros, null
    gives null.

    A vector's size is the number of labels less one, but it holds one index and one value, however many labels there
    are; the labels are counted once and the size is read from their table."""
    tables = _label_tables(df, columns)
    indexed = _indexed(df, tables)
    for c, table in tables.items():
        last = table.select(F.col("place").cast("double").alias(f"{c}_indexed")).agg(F.max(f"{c}_indexed").alias(f"{c}_indexed"))
        encoder = OneHotEncoder(inputCols=[f"{c}_indexed"], outputCols=[f"{c}_encoded"])
        if last.first()[0] is None:
            indexed = indexed.withColumn(f"{c}_encoded", F.lit(None).cast(VectorUDT()))
        else:
            known = F.col(f"{c}_encoded")
            indexed = encoder.fit(last).transform(indexed.fillna({f"{c}_indexed": 0.0}).withColumn("_known", F.col(c).isNotNull()))
            indexed = indexed.withColumns({f"{c}_encoded": F.when(F.col("_known"), known), f"{c}_indexed": F.when(F.col("_known"), F.col(f"{c}_indexed"))}).drop("_known")
    return indexed


def sparse_parts(vector: Column) -> Column:
    """``size``, ``indices`` and ``values`` of a sparse vector, without making it dense."""
    return F.unwrap_udt(vector)


def dummies(df: DataFrame, column: str, values: Sequence[str] | None = None) -> DataFrame:
    """A true/false column ``<column>_<value>`` per value. The values name the columns of the result, so a
    list that is not given is read from the table to the driver before the plan can be made: give the list
    where it is known, and use :func:`string_index`, whose labels stay in a table, for a column of many values."""
    if values is None:
        found = df.select(column).filter(F.col(column).isNotNull()).distinct().collect()
        values = sorted(row[0] for row in found)
    return df.withColumns({f"{column}_{v}": F.coalesce(F.col(column) == v, F.lit(False)) for v in values})


def age_buckets(df: DataFrame, splits: Sequence[float] = fixed.AGE_BUCKET_SPLITS) -> DataFrame:
    bucketizer = Bucketizer(splits=list(splits), inputCol="age", outputCol="age_bucket", handleInvalid="keep")
    return bucketizer.transform(df)


def quantile_buckets(df: DataFrame, column: str, output: str, buckets: int = 5) -> DataFrame:
    """Buckets of about equal size between exact cut points: the values at each share of the rows. A value
    at a cut point belongs to the bucket above it, equal cut points count once, nulls have no bucket."""
    cuts = as_struct(quantiles(df, [column], [i / buckets for i in range(1, buckets)], discrete=True))[column]
    bounded = df.withColumn("_cuts", cuts)
    above = F.size(F.filter(F.array_distinct("_cuts"), lambda cut: cut <= F.col(column))).cast("double")
    return bounded.withColumn(output, F.when(F.col(column).isNotNull(), above)).drop("_cuts")


def quartile_labels(df: DataFrame, column: str, output: str, names: Sequence[str] = ("Q1", "Q2", "Q3", "Q4")) -> DataFrame:
    """Right-closed bins between exact quantiles; the smallest value belongs to the first."""
    edges = as_struct(quantiles(df, [column], [i / len(names) for i in range(len(names) + 1)]))
    bounded = df.withColumn("_edges", edges[column])
    limits = [F.col("_edges")[i] for i in range(len(names) + 1)]
    return bounded.withColumn(output, labels.cut(F.col(column), limits, names, lowest_included=True)).drop("_edges")


def flags(df: DataFrame) -> DataFrame:
    """1 or 0 for incomes above the 80th percentile and for excellent credit."""
    limit = as_struct(quantiles(df, ["income"], [fixed.HIGH_EARNER_QUANTILE]))["income"][0]
    return df.withColumns(
        {
            "high_earner": F.when(F.col("income") > limit, 1).otherwise(0),
            "excellent_credit": F.when(F.col("credit_score") > fixed.EXCELLENT_CREDIT, 1).otherwise(0),
        }
    )


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)


def standard_scale(df: DataFrame, columns: Sequence[str], output: str = "scaled_features") -> DataFrame:
    """Centre and divide by the sample deviation, as one vector column."""
    assembled = assemble(df, columns)
    scaler = StandardScaler(inputCol="features", outputCol=output, withMean=True, withStd=True)
    return scaler.fit(assembled).transform(assembled)


def min_max_scale(df: DataFrame, columns: Sequence[str], output: str = "scaled_features") -> DataFrame:
    assembled = assemble(df, columns)
    return MinMaxScaler(inputCol="features", outputCol=output).fit(assembled).transform(assembled)


def l2_normalize(df: DataFrame, columns: Sequence[str], output: str = "normed_features") -> DataFrame:
    return Normalizer(inputCol="features", outputCol=output, p=2.0).transform(assemble(df, columns))


def feature_pipeline(customers: DataFrame) -> DataFrame:
    """Index three label columns, bucket age and income, assemble and scale the numeric columns.

    Labels and cut points stay in tables; means and deviations come from one aggregate. The customers are
    read once and kept until :func:`custlytics.session.release`."""
    filled = impute(reused(customers), ["income", "credit_score"])
    indexed = string_index(filled, ["region", "education", "marital_status"])
    indexed = indexed.withColumnRenamed("marital_status_indexed", "marital_indexed")
    bucketed = quantile_buckets(age_buckets(indexed), "income", "income_quintile")
    return standard_scale(bucketed, PIPELINE_FEATURES)


def principal_components(df: DataFrame, vector: str, k: int, output: str = "pca_features") -> DataFrame:
    """The first ``k`` components of a centred vector column."""
    return PCA(k=k, inputCol=vector, outputCol=output).fit(df).transform(df)


def covariances(columns: Sequence[str]) -> Column:
    """The sample covariances of all pairs of columns as an array of rows, one aggregate."""
    return F.array(*[F.array(*[F.covar_samp(a, b) for b in columns]) for a in columns])


def principal_axes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(component, variance, loadings): all principal axes of the columns, the one of greatest variance first.

    Covariances come from one aggregate; the driver solves a matrix as wide as the list of columns. Of an axis the
    loading of greatest size is positive (of equal ones the first), so that it does not depend on the solver.
    Rows with a null in a pair of columns do not count for it."""
    rows = df.agg(covariances(columns).alias("c")).first().c
    variances, axes = np.linalg.eigh(np.array(rows, float))
    found = []
    for k, (variance, axis) in enumerate(sorted(zip(variances.tolist(), axes.T, strict=True), key=lambda x: -x[0])):
        largest = int(np.argmax(np.abs(axis) > np.abs(axis).max() - 1e-12))
        found.append((k, variance, (axis * np.sign(axis[largest])).tolist()))
    return df.sparkSession.createDataFrame(found, "component int, variance double, loadings array<double>")


def axis_errors(axes: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``axes`` with ``error``, how far the covariances times an axis are from its variance times the axis, as a part of
    the greatest variance."""
    matrix = df.agg(covariances(columns).alias("c")).scalar()

    def product(row: Column) -> Column:
        return F.aggregate(F.zip_with(row, "loadings", lambda c, v: c * v), F.lit(0.0), lambda a, b: a + b)

    off = F.zip_with(F.transform("_c", product), "loadings", lambda image, v: F.abs(image - F.col("variance") * v))
    greatest = axes.agg(F.max("variance")).scalar()
    return axes.withColumn("_c", matrix).withColumn("error", F.array_max(off) / greatest).drop("_c")


def components_for_variance(
    df: DataFrame, vector: str, size: int, share: float = fixed.PCA_VARIANCE, output: str = "pca_features"
) -> DataFrame:
    """As many components as explain ``share`` of the variance, as an array."""
    model = PCA(k=size, inputCol=vector, outputCol="_all").fit(df)
    explained, k = 0.0, 0
    while k < size and explained < share:
        explained += float(model.explainedVariance[k])
        k += 1
    projected = model.transform(df)
    return projected.withColumn(output, F.slice(vector_to_array("_all"), 1, k)).drop("_all")


def with_label_above_median(df: DataFrame, target: str, label: str = "label") -> DataFrame:
    """1 where ``target`` is above its median, else 0."""
    median = as_struct(quantiles(df, [target], [0.5]))[target][0]
    return df.withColumn(label, F.when(F.col(target) > median, 1).otherwise(0))


def anova_scores(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """F statistic of each column between the classes of ``label``.

    The table is read once, into count, mean and variance per class; the scores come from those.
    """
    per_class = df.groupBy(label).agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.count(c).alias("n"),
                    F.avg(c).alias("mean"),
                    F.var_pop(c).alias("variance"),
                )
                for c in columns
            ]
        ).alias("_all")
    )
    tall = per_class.select(F.inline("_all"))
    feature = Window.partitionBy("feature")
    centre = F.sum(F.col("n") * F.col("mean")).over(feature) / F.sum("n").over(feature)
    parts = tall.withColumn("_off", F.col("mean") - centre)
    sums = parts.groupBy("feature").agg(
        F.sum("n").alias("_rows"),
        F.count(F.lit(1)).alias("_classes"),
        F.sum(F.col("n") * F.col("_off") * F.col("_off")).alias("_between"),
        F.sum(F.col("n") * F.col("variance")).alias("_within"),
    )
    between = F.col("_between") / (F.col("_classes") - 1)
    within = F.col("_within") / (F.col("_rows") - F.col("_classes"))
    return sums.select("feature", F.try_divide(between, within).alias("score"))


def best_features(df: DataFrame, columns: Sequence[str], target: str, k: int = 10) -> DataFrame:
    """The ``k`` columns that best separate rows above from rows below the median of ``target``."""
    filled = impute(with_label_above_median(df, target), columns, "median")
    return anova_scores(filled, columns, "label").orderBy(F.desc("score"), "feature").limit(k)


def _selected(model, columns: Sequence[str]) -> list[str]:
    return [columns[i] for i in model.selectedFeatures]


def select_by_variance(df: DataFrame, columns: Sequence[str], threshold: float) -> list[str]:
    """Columns whose sample variance is above ``threshold``."""
    selector = VarianceThresholdSelector(featuresCol="features", outputCol="selected", varianceThreshold=threshold)
    return _selected(selector.fit(assemble(df, columns)), columns)


def select_univariate(df: DataFrame, columns: Sequence[str], label: str, k: int) -> list[str]:
    """The ``k`` columns with the most significant F test."""
    selector = UnivariateFeatureSelector(
        featuresCol="features", labelCol=label, outputCol="selected", selectionMode="numTopFeatures"
    )
    selector.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)
    return _selected(selector.fit(assemble(df, columns)), columns)


def select_chi_square(df: DataFrame, columns: Sequence[str], label: str, k: int) -> list[str]:
    """The ``k`` categorical columns that depend most on the label."""
    selector = ChiSqSelector(numTopFeatures=k, featuresCol="features", labelCol=label, outputCol="selected")
    return _selected(selector.fit(assemble(df, columns)), columns)


def split_by_key(df: DataFrame, key: str, test_percent: int = 20) -> DataFrame:
    """``part`` is ``test`` for about ``test_percent`` of the keys, the same ones on every run."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn("part", F.when(bucket < test_percent, "test").otherwise("train"))

