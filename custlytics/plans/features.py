"""Queries on feature engineering."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, functions as F

from custlytics.operators import cleaning, customer, features
from custlytics.plans.registry import query, rounded
from custlytics.sources.tables import C_SQL, MARITAL_STATUSES, customers, table

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
LABELS = ["region", "education", "marital_status"]
SCALED = features.PIPELINE_FEATURES
CANDIDATES = ["age", "income", "credit_score", "years_employed", "debt_ratio", "num_accounts", "total_spent"]


def _indexed_sql(column: str) -> str:
    return (
        f"{column}_index as (select {column}, row_number() over (order by count(*) desc, {column}) - 1 as place, "
        f"count(*) over () as labels from customers group by {column})"
    )


INDEX_SQL = C_SQL + "," + ",".join(_indexed_sql(c) for c in LABELS)
INDEX_JOINS = " from customers " + " ".join(f"join {c}_index using ({c})" for c in LABELS)
FILLED_SQL = """,
filled as (
  select * replace (coalesce(income, avg(income) over ()) as income,
                    coalesce(cast(credit_score as double), avg(credit_score) over ()) as credit_score)
  from customers)"""
MEDIAN_FILLED_SQL = """,
filled as (
  select * replace (coalesce(income, (select median(income) from customers)) as income,
                    coalesce(cast(credit_score as double), (select median(credit_score) from customers))
                      as credit_score)
  from customers),
labelled as (
  select *, case when purchase_amount > (select median(purchase_amount) from customers) then 1 else 0 end as label
  from filled)"""


def _scaled(names, deviation: str) -> str:
    return ", ".join(f"round(({c} - avg({c}) over ()) / {deviation}({c}) over (), 6) as {c}" for c in names)


def _elements(array: Column, names, digits: int = 6) -> list[Column]:
    return [F.round(array[i], digits).alias(c) for i, c in enumerate(names)]


@query(
    INDEX_SQL
    + "select customer_id, "
    + ", ".join(f"cast({c}_index.place as double) as {c}_indexed" for c in LABELS)
    + INDEX_JOINS
)
def string_index(spark, sf_dir):
    indexed = features.string_index(customers(spark, sf_dir), LABELS)
    return indexed.select("customer_id", *[f"{c}_indexed" for c in LABELS])


@query(
    INDEX_SQL
    + """
select customer_id,
  list_aggregate(list_transform(range(region_index.labels - 1), lambda i: case when i = region_index.place then 1 else 0 end),
                 'string_agg', ',') as region_encoded,
  list_aggregate(list_transform(range(education_index.labels - 1),
                                lambda i: case when i = education_index.place then 1 else 0 end),
                 'string_agg', ',') as education_encoded"""
    + INDEX_JOINS
)
def one_hot(spark, sf_dir):
    encoded = features.one_hot(customers(spark, sf_dir), ["region", "education"])

    def joined(c: str) -> Column:
        return F.array_join(vector_to_array(f"{c}_encoded").cast("array<int>").cast("array<string>"), ",").alias(f"{c}_encoded")

    return encoded.select("customer_id", joined("region"), joined("education"))


@query(
    """
with counted as (select c_name, row_number() over (order by count(*) desc, c_name) - 1 as place, count(*) over () as labels
                 from customer group by c_name)
select c_custkey as customer_id, cast(labels - 1 as integer) as size,
       case when place < labels - 1 then cast(place as integer) end as place, case when place < labels - 1 then 1.0::double end as value
from customer join counted using (c_name)"""
)
def one_hot_wide(spark, sf_dir):
    """As many labels as customers: a row holds one index and one value of its vector."""
    encoded = features.one_hot(table(spark, sf_dir, "customer"), ["c_name"])
    parts = encoded.select("c_custkey", features.sparse_parts(F.col("c_name_encoded")).alias("v"))
    first = [F.get("v.indices", F.lit(0)).alias("place"), F.get("v.values", F.lit(0)).alias("value")]
    return parts.select(F.col("c_custkey").alias("customer_id"), "v.size", *first)


def _dummy_name(column: str, value: str) -> str:
    return f"{column}_{value}".lower().replace(" ", "_")


@query(
    C_SQL
    + "select customer_id, "
    + ", ".join(f"region = '{v}' as {_dummy_name('region', v)}" for v in REGIONS)
    + ", "
    + ", ".join(f"marital_status = '{v}' as {_dummy_name('marital_status', v)}" for v in MARITAL_STATUSES)
    + " from customers"
)
def one_hot_dummies(spark, sf_dir):
    wide = features.dummies(customers(spark, sf_dir), "region", REGIONS)
    wide = features.dummies(wide, "marital_status", MARITAL_STATUSES)
    names = [f"region_{v}" for v in REGIONS] + [f"marital_status_{v}" for v in MARITAL_STATUSES]
    return wide.select("customer_id", *[F.col(f"`{n}`").alias(_dummy_name("", n)[1:]) for n in names])


@query(
    C_SQL
    + """
select customer_id, cast(case when age < 25 then 0 when age < 35 then 1 when age < 45 then 2 when age < 55 then 3
                              when age < 65 then 4 else 5 end as double) as age_bucket from customers"""
)
def age_buckets(spark, sf_dir):
    return features.age_buckets(customers(spark, sf_dir)).select("customer_id", "age_bucket")


@query(
    C_SQL
    + FILLED_SQL
    + """,
cuts as (select quantile_disc(income, [0.2, 0.4, 0.6, 0.8]) as q from filled)
select customer_id, cast(len(list_filter(list_distinct(q), lambda c: c <= income)) as double) as income_quintile
from filled, cuts"""
)
def income_quintile(spark, sf_dir):
    filled = cleaning.impute(customers(spark, sf_dir), ["income"])
    return features.quantile_buckets(filled, "income", "income_quintile").select("customer_id", "income_quintile")


@query(C_SQL + FILLED_SQL + f"select customer_id, {_scaled(SCALED, 'stddev')} from filled")
def standard_scale(spark, sf_dir):
    filled = cleaning.impute(customers(spark, sf_dir), ["income", "credit_score"])
    scaled = features.standard_scale(filled, SCALED)
    array = vector_to_array("scaled_features")
    return scaled.select("customer_id", *_elements(array, SCALED))


@query(
    INDEX_SQL
    + FILLED_SQL
    + ",scaled as (select customer_id, "
    + _scaled(SCALED, "stddev")
    + ", age as raw_age, region, education, marital_status from filled)"
    + "select customer_id, "
    + ", ".join(SCALED)
    + """, cast(region_index.place as double) as region_indexed,
  cast(education_index.place as double) as education_indexed,
  cast(marital_status_index.place as double) as marital_indexed,
  cast(case when raw_age < 25 then 0 when raw_age < 35 then 1 when raw_age < 45 then 2 when raw_age < 55 then 3
            when raw_age < 65 then 4 else 5 end as double) as age_bucket"""
    + INDEX_JOINS.replace("from customers", "from scaled")
)
def fitted_features(spark, sf_dir):
    built = features.feature_pipeline(customers(spark, sf_dir))
    array = vector_to_array("scaled_features")
    return built.select(
        "customer_id", *_elements(array, SCALED), "region_indexed", "education_indexed", "marital_indexed", "age_bucket"
    )


@query(None)
def pca_features(spark, sf_dir):
    built = features.feature_pipeline(customers(spark, sf_dir))
    reduced = features.principal_components(built, "scaled_features", 3)
    return reduced.select("customer_id", vector_to_array("pca_features").alias("pca_features"))


def _facts(name: str, array: Column, size: int) -> Column:
    """What holds for principal components whatever their signs."""
    columns = [array[i] for i in range(size)]
    centred = reduce(lambda a, b: a & b, [F.abs(F.avg(c)) < 1e-6 for c in columns])
    apart = reduce(
        lambda a, b: a & b,
        [F.abs(F.covar_samp(columns[i], columns[j])) < 1e-6 for i in range(size) for j in range(i)],
    )
    falling = reduce(lambda a, b: a & b, [F.variance(columns[i]) >= F.variance(columns[i + 1]) - 1e-9 for i in range(size - 1)])
    return F.struct(F.lit(name).alias("part"), centred.alias("centred"), apart.alias("uncorrelated"), falling.alias("falling"))


@query(
    C_SQL
    + MEDIAN_FILLED_SQL
    + f""",
scaled as (select {_scaled(CANDIDATES, 'stddev')} from filled)
select part, true as centred, true as uncorrelated, true as falling, round(total, 4) as total_variance
from (select {' + '.join(f'var_samp({c})' for c in CANDIDATES)} as total from scaled), (select unnest(['first', 'all']) as part)"""
)
def pca_facts(spark, sf_dir):
    """Means, covariances and variances of the first three and of all components; all components together
    keep the variance of the scaled columns."""
    filled = cleaning.impute(customers(spark, sf_dir), CANDIDATES, "median")
    scaled = features.standard_scale(filled, CANDIDATES)
    size = len(CANDIDATES)
    every = features.components_for_variance(scaled, "scaled_features", size, share=2.0).select(F.col("pca_features").alias("p"))
    total = reduce(lambda a, b: a + b, [F.variance(F.col("p")[i]) for i in range(size)])
    found = every.agg(_facts("first", F.col("p"), 3).alias("x"), _facts("all", F.col("p"), size).alias("y"), total.alias("total"))
    rows = found.select(F.explode(F.array("x", "y")).alias("f"), F.round("total", 4).alias("total_variance"))
    return rows.select("f.*", "total_variance")


@query(None)
def pca_95(spark, sf_dir):
    filled = cleaning.impute(customers(spark, sf_dir), CANDIDATES, "median")
    scaled = features.standard_scale(filled, CANDIDATES)
    reduced = features.components_for_variance(scaled, "scaled_features", len(CANDIDATES))
    return reduced.select("customer_id", "pca_features")


@query(
    C_SQL
    + """,
edges as (select quantile_cont(income, [0.25, 0.5, 0.75]) as q from customers)
select customer_id, case when income <= q[1] then 'Q1' when income <= q[2] then 'Q2' when income <= q[3] then 'Q3'
                         when income is not null then 'Q4' end as income_quartile from customers, edges"""
)
def qcut_income(spark, sf_dir):
    cut = features.quartile_labels(customers(spark, sf_dir), "income", "income_quartile")
    return cut.select("customer_id", "income_quartile")


@query(
    C_SQL
    + """
select customer_id, case when income > (select quantile_cont(income, 0.8) from customers) then 1 else 0 end as high_earner,
       case when credit_score > 740 then 1 else 0 end as excellent_credit from customers"""
)
def flag_features(spark, sf_dir):
    return features.flags(customers(spark, sf_dir)).select("customer_id", "high_earner", "excellent_credit")


@query(C_SQL + f"select customer_id, {_scaled(CANDIDATES[3:], 'stddev_pop')} from customers")
def zscore_pop(spark, sf_dir):
    scored = customer.zscore(customers(spark, sf_dir), CANDIDATES[3:], population=True)
    return scored.select("customer_id", *[F.round(f"{c}_zscore", 6).alias(c) for c in CANDIDATES[3:]])


def _anova_sql() -> str:
    lines = " union all ".join(
        f"select '{c}' as feature, label, count({c}) as n, avg({c}) as m, var_pop({c}) as v from labelled group by label"
        for c in CANDIDATES
    )
    return (
        C_SQL
        + MEDIAN_FILLED_SQL
        + f""",
classes as ({lines}),
centres as (select feature, sum(n * m) / sum(n) as centre from classes group by feature),
scores as (
  select feature, (sum(n * (m - centre) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) as score
  from classes join centres using (feature) group by feature)
"""
    )


@query(_anova_sql() + "select feature, round(score, 6) as score from scores order by scores.score desc limit 5")
def anova_topk(spark, sf_dir):
    best = features.best_features(customers(spark, sf_dir), CANDIDATES, "purchase_amount", k=5)
    return best.select("feature", rounded("score", 6))


def _chosen(spark, names):
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query(_anova_sql() + "select feature from scores order by score desc limit 3")
def select_univariate(spark, sf_dir):
    labelled = features.with_label_above_median(customers(spark, sf_dir), "purchase_amount")
    filled = cleaning.impute(labelled, CANDIDATES, "median")
    return _chosen(spark, features.select_univariate(filled, CANDIDATES, "label", 3))


@query(
    C_SQL
    + MEDIAN_FILLED_SQL
    + ",spread as ("
    + " union all ".join(f"select '{c}' as feature, var_samp({c}) as v from filled" for c in CANDIDATES)
    + ") select feature from spread where v > 100"
)
def select_variance(spark, sf_dir):
    filled = cleaning.impute(customers(spark, sf_dir), CANDIDATES, "median")
    return _chosen(spark, features.select_by_variance(filled, CANDIDATES, 100.0))


def _chi_square_sql(columns) -> str:
    """Independence of each column and the label; all columns must have the same number of values."""
    parts = " union all ".join(f"select '{c}' as feature, {c} as value, label from labelled" for c in columns)
    return (
        C_SQL
        + MEDIAN_FILLED_SQL
        + f""",
tall as ({parts}),
cells as (select feature, value, label, count(*) as n from tall group by all),
expected as (
  select feature, value, label, n,
         sum(n) over (partition by feature, value) * sum(n) over (partition by feature, label)
         / sum(n) over (partition by feature) as e
  from cells),
scores as (select feature, sum((n - e) ** 2 / e) as score from expected group by feature)
"""
    )


@query(_chi_square_sql(["region", "education"]) + "select feature || '_indexed' as feature from scores order by score desc limit 1")
def select_chisq(spark, sf_dir):
    indexed = features.string_index(customers(spark, sf_dir), ["region", "education"])
    labelled = features.with_label_above_median(indexed, "purchase_amount")
    return _chosen(
        spark, features.select_chi_square(labelled, ["region_indexed", "education_indexed"], "label", 1)
    )


@query(
    C_SQL
    + MEDIAN_FILLED_SQL
    + "select customer_id, "
    + ", ".join(
        f"round(({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()), 6) as {c}" for c in SCALED
    )
    + " from filled"
)
def minmax_scale(spark, sf_dir):
    filled = cleaning.impute(customers(spark, sf_dir), ["income", "credit_score"], "median")
    scaled = features.min_max_scale(filled, SCALED)
    return scaled.select("customer_id", *_elements(vector_to_array("scaled_features"), SCALED))


@query(
    C_SQL
    + MEDIAN_FILLED_SQL
    + f",sized as (select *, sqrt({' + '.join(f'{c} * {c}' for c in SCALED)}) as size from filled)"
    + "select customer_id, "
    + ", ".join(f"round({c} / size, 8) as {c}" for c in SCALED)
    + " from sized"
)
def l2_normalize(spark, sf_dir):
    filled = cleaning.impute(customers(spark, sf_dir), ["income", "credit_score"], "median")
    normed = features.l2_normalize(filled, SCALED)
    return normed.select("customer_id", *_elements(vector_to_array("normed_features"), SCALED, 8))


@query(
    C_SQL
    + """
select customer_id, case when cast('0x' || substring(md5(cast(customer_id as varchar)), 1, 8) as bigint) % 100 < 20
                         then 'test' else 'train' end as part from customers"""
)
def hash_split(spark, sf_dir):
    return features.split_by_key(customers(spark, sf_dir), "customer_id").select("customer_id", "part")


@query(
    C_SQL
    + """,
cov as (
  select covar_samp(years_employed, years_employed) as a, covar_samp(years_employed, num_accounts) as b,
         covar_samp(num_accounts, num_accounts) as d from customers),
variances as (
  select *, unnest([0, 1]) as component,
         unnest([(a + d + sqrt((a - d) ** 2 + 4 * b * b)) / 2, (a + d - sqrt((a - d) ** 2 + 4 * b * b)) / 2]) as variance from cov),
axes as (select *, b / sqrt(b * b + (variance - a) ** 2) as x, (variance - a) / sqrt(b * b + (variance - a) ** 2) as y from variances),
signed as (select *, sign(case when abs(x) >= abs(y) then x else y end) as s from axes)
select cast(component as integer) as component, round(variance, 6) as variance, round(x * s, 6) as x, round(y * s, 6) as y from signed"""
)
def pca_axes(spark, sf_dir):
    """Values and signs of the principal axes of two columns."""
    axes = features.principal_axes(customers(spark, sf_dir), ["years_employed", "num_accounts"])
    return axes.select("component", rounded("variance", 6), *[F.round(F.col("loadings")[k], 6).alias(c) for k, c in enumerate("xy")])


@query(
    C_SQL
    + FILLED_SQL
    + f""",
moments as (select {" + ".join(f"var_samp({c})" for c in SCALED)} as total from filled)
select cast(unnest(range({len(SCALED)})) as integer) as component, true as solves, true as signed, round(total, 4) as total from moments"""
)
def pca_residuals(spark, sf_dir):
    """Every axis of the numeric columns solves the covariances, has its sign by the rule, and all variances add up to
    the columns' own."""
    filled = cleaning.impute(customers(spark, sf_dir), ["income", "credit_score"])
    axes = features.axis_errors(features.principal_axes(filled, SCALED), filled, SCALED)
    total = axes.agg(F.sum("variance")).scalar()
    largest = F.array_max(F.transform("loadings", F.abs))
    signed = F.array_max("loadings") >= largest - 1e-12
    return axes.select("component", (F.col("error") < 1e-6).alias("solves"), signed.alias("signed"), F.round(total, 4).alias("total"))
