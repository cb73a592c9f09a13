"""Queries on projections, filters, conditional columns and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from custlytics.functions import dates, fixed_values as fixed, labels
from custlytics.operators import aggregates, cleaning, projections
from custlytics.plans.registry import day, query, rounded
from custlytics.sources.tables import C_SQL, T_SQL, customers, products, table, transactions, PRODUCTS_SQL, with_sql

AS_OF = "2024-08-20"


@query(
    C_SQL
    + """
select customer_id, name, email, age, income, credit_score, years_employed, region, education, marital_status,
       has_mortgage, num_accounts, cast(registration_date as varchar) as registration_date,
       cast(last_login as varchar) as last_login
from customers"""
)
def fixture_customers(spark, sf_dir):
    return customers(spark, sf_dir).select(
        "customer_id", "name", "email", "age", "income", "credit_score", "years_employed", "region", "education",
        "marital_status", "has_mortgage", "num_accounts", day("registration_date"), day("last_login"),
    )


@query(
    T_SQL
    + """
select transaction_id, customer_id, cast(transaction_date as varchar) as transaction_date,
       round(amount, 5) as amount, category, merchant, is_online, is_fraud from transactions"""
)
def fixture_transactions(spark, sf_dir):
    return transactions(spark, sf_dir).select(
        "transaction_id", "customer_id", day("transaction_date"), rounded("amount", 5), "category", "merchant",
        "is_online", "is_fraud",
    )


@query(
    with_sql(PRODUCTS_SQL)
    + """
select product_id, product_name, category, price, round(rating, 2) as rating, reviews_count, in_stock,
       cast(launch_date as varchar) as launch_date from products"""
)
def fixture_products(spark, sf_dir):
    return products(spark, sf_dir).select(
        "product_id", "product_name", "category", "price", rounded("rating", 2), "reviews_count", "in_stock",
        day("launch_date"),
    )


@query(
    C_SQL
    + """
select * replace (case when customer_id % 30 <> 0 then years_employed end as years_employed,
                  case when customer_id % 20 <> 0 then debt_ratio end as debt_ratio,
                  cast(registration_date as varchar) as registration_date, cast(last_login as varchar) as last_login)
from customers"""
)
def fixture_features(spark, sf_dir):
    blanked = projections.nulls_where_divisible(
        customers(spark, sf_dir), "customer_id", {"years_employed": 30, "debt_ratio": 20}
    )
    return blanked.withColumns({c: F.col(c).cast("string") for c in ("registration_date", "last_login")})


@query(C_SQL + "select customer_id, age, income, region from customers where income > 80000")
def high_income(spark, sf_dir):
    return projections.high_income(customers(spark, sf_dir))


@query(
    C_SQL
    + """
select customer_id, age, education, has_mortgage from customers
where age between 25 and 45 and education in ('BUILDING', 'MACHINERY') and has_mortgage"""
)
def complex_filter(spark, sf_dir):
    found = projections.mortgage_holders(customers(spark, sf_dir), educations=["BUILDING", "MACHINERY"])
    return found.select("customer_id", "age", "education", "has_mortgage")


@query(
    C_SQL
    + """
select customer_id, case when age < 25 then 'Young' when age < 45 then 'Adult' when age < 65 then 'Middle-aged'
                         else 'Senior' end as age_group from customers"""
)
def age_group4(spark, sf_dir):
    return cleaning.with_profile_labels(customers(spark, sf_dir)).select("customer_id", "age_group")


@query(
    C_SQL
    + """
select customer_id, case when age < 30 then 'Young' when age < 50 then 'Adult' else 'Senior' end as age_group
from customers"""
)
def age_group3(spark, sf_dir):
    group = labels.age_group(F.col("age"), fixed.AGE_GROUPS_THREE)
    return customers(spark, sf_dir).select("customer_id", group.alias("age_group"))


@query(
    C_SQL
    + """
select customer_id, case when income < 40000 then 'Low' when income < 80000 then 'Medium' else 'High' end
       as income_bracket from customers"""
)
def income_bracket(spark, sf_dir):
    return cleaning.with_profile_labels(customers(spark, sf_dir)).select("customer_id", "income_bracket")


@query(
    C_SQL
    + f"""
select customer_id, cast(date '{AS_OF}' - registration_date as integer) as days_since_registration from customers"""
)
def tenure_days(spark, sf_dir):
    labelled = cleaning.with_profile_labels(customers(spark, sf_dir), F.lit(AS_OF).cast("date"))
    return labelled.select("customer_id", "days_since_registration")


@query(
    """
with texts as (
  select o_orderkey, case when o_orderstatus = 'P' then strftime(o_orderdate, '%d/%m/%Y')
                          else strftime(o_orderdate, '%Y-%m-%d') end as written from orders)
select o_orderkey, cast(try_strptime(written, '%Y-%m-%d') as date)::varchar as parsed from texts"""
)
def date_parse(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    written = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    texts = orders.select("o_orderkey", written.alias("parsed"))
    return projections.parse_dates(texts, ["parsed"]).select("o_orderkey", day("parsed"))


SEGMENT_SQL = (
    C_SQL
    + """,
segmented as (
  select *, case when income > 80000 and credit_score > 750 then 'Premium'
                 when income > 60000 and credit_score > 700 then 'Gold'
                 when income > 40000 and credit_score > 650 then 'Silver' else 'Bronze' end as customer_segment,
            case when credit_score > 750 then 1 when credit_score > 700 then 2 when credit_score > 650 then 3
                 when credit_score > 600 then 4 else 5 end as risk_score
  from customers
)"""
)


@query(SEGMENT_SQL + "select customer_id, customer_segment from segmented")
def segment_customers(spark, sf_dir):
    return cleaning.with_segments(customers(spark, sf_dir)).select("customer_id", "customer_segment")


@query(SEGMENT_SQL + "select customer_id, risk_score from segmented")
def risk_score(spark, sf_dir):
    return cleaning.with_segments(customers(spark, sf_dir)).select("customer_id", "risk_score")


@query(
    SEGMENT_SQL
    + """
select customer_segment, count(*) as count, round(avg(income), 4) as avg_income,
       round(avg(credit_score), 4) as avg_credit_score from segmented group by customer_segment"""
)
def segment_summary(spark, sf_dir):
    summary = aggregates.segment_summary(cleaning.with_segments(customers(spark, sf_dir)))
    return summary.select("customer_segment", "count", rounded("avg_income"), rounded("avg_credit_score"))


@query(
    C_SQL
    + """
select customer_id,
       case when credit_score <= 0 then null when credit_score <= 580 then 'Poor' when credit_score <= 669 then 'Fair'
            when credit_score <= 739 then 'Good' when credit_score <= 799 then 'Very Good'
            when credit_score <= 850 then 'Excellent' end as credit_score_category,
       case when age <= 0 then null when age <= 25 then '18-25' when age <= 35 then '26-35' when age <= 50 then '36-50'
            when age <= 65 then '51-65' when age <= 100 then '65+' end as age_group
from customers"""
)
def cut_bins(spark, sf_dir):
    return projections.binned(customers(spark, sf_dir)).select("customer_id", "credit_score_category", "age_group")


@query(
    C_SQL
    + """
select customer_id, round(ln(1 + purchase_amount), 8) as purchase_amount_log, round(ln(1 + income), 8) as income_log
from customers"""
)
def log1p_cols(spark, sf_dir):
    logged = projections.log_columns(customers(spark, sf_dir), ["purchase_amount", "income"])
    return logged.select("customer_id", rounded("purchase_amount_log", 8), rounded("income_log", 8))


@query(
    C_SQL
    + """
select customer_id, case education when 'AUTOMOBILE' then 1 when 'BUILDING' then 2 when 'FURNITURE' then 3
                                   when 'HOUSEHOLD' then 4 end as education_encoded from customers"""
)
def ordinal_encode(spark, sf_dir):
    codes = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4}
    code = labels.ordinal_code(F.col("education"), codes)
    return customers(spark, sf_dir).select("customer_id", code.alias("education_encoded"))


@query(
    C_SQL
    + """
select customer_id, round(debt_ratio * income, 4) as debt_to_income_ratio,
       round(income * credit_score, 4) as income_credit_interaction, round(age * income, 4) as age_income_interaction
from customers"""
)
def interactions(spark, sf_dir):
    return projections.interactions(customers(spark, sf_dir)).select(
        "customer_id",
        rounded("debt_to_income_ratio"),
        rounded("income_credit_interaction"),
        rounded("age_income_interaction"),
    )


@query(C_SQL + "select customer_id, age, 'processed' as status from customers where age > 30")
def tag_rows(spark, sf_dir):
    return projections.tagged(customers(spark, sf_dir)).select("customer_id", "age", "status")


@query(
    C_SQL
    + """
select customer_id, round(coalesce(income, avg(income) over ()), 4) as income,
       round(coalesce(credit_score, avg(credit_score) over ()), 4) as credit_score from customers"""
)
def impute_mean(spark, sf_dir):
    filled = cleaning.impute(customers(spark, sf_dir), ["income", "credit_score"])
    return filled.select("customer_id", rounded("income"), rounded("credit_score"))


@query(
    C_SQL
    + """
select customer_id, round(coalesce(income, (select median(income) from customers)), 4) as income,
       round(coalesce(credit_score, (select median(credit_score) from customers)), 4) as credit_score
from customers"""
)
def impute_median(spark, sf_dir):
    filled = cleaning.impute(customers(spark, sf_dir), ["income", "credit_score"], "median")
    return filled.select("customer_id", rounded("income"), rounded("credit_score"))


CAPPED = ["income", "credit_score", "purchase_amount"]
IQR_SQL = (
    C_SQL
    + """,
quartiles as (
  select column_name, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3
  from (select cast(income as double) as income, cast(credit_score as double) as credit_score, purchase_amount
        from customers) unpivot (v for column_name in (income, credit_score, purchase_amount))
  group by column_name
),
bounds as (select column_name, q1 - 1.5 * (q3 - q1) as lower_bound, q3 + 1.5 * (q3 - q1) as upper_bound from quartiles)
"""
)


@query(
    IQR_SQL
    + """
select customer_id,
  round(case when income < i.lower_bound then i.lower_bound when income > i.upper_bound then i.upper_bound
             else income end, 4) as income,
  round(case when credit_score < c.lower_bound then c.lower_bound when credit_score > c.upper_bound then c.upper_bound
             else credit_score end, 4) as credit_score,
  round(case when purchase_amount < p.lower_bound then p.lower_bound
             when purchase_amount > p.upper_bound then p.upper_bound else purchase_amount end, 4) as purchase_amount
from customers
join bounds i on i.column_name = 'income' join bounds c on c.column_name = 'credit_score'
join bounds p on p.column_name = 'purchase_amount'"""
)
def iqr_cap(spark, sf_dir):
    capped = cleaning.cap_outliers(customers(spark, sf_dir), CAPPED)
    return capped.select("customer_id", *[rounded(c) for c in CAPPED])


@query(
    IQR_SQL
    + """
select column_name as column, round(lower_bound, 4) as lower_bound, round(upper_bound, 4) as upper_bound,
       (select count(*) from customers
        where case column_name when 'income' then income when 'credit_score' then credit_score
                               else purchase_amount end not between lower_bound and upper_bound) as outliers
from bounds"""
)
def iqr_outlier_counts(spark, sf_dir):
    counted = cleaning.outlier_counts(customers(spark, sf_dir), CAPPED)
    return counted.select("column", rounded("lower_bound"), rounded("upper_bound"), "outliers")


@query(
    C_SQL
    + """
select customer_id, region, upper(region) as region_upper, cast(length(education) as integer) as education_length,
       substring(region, 1, 1) || '-' || substring(education, 1, 1) as initials,
       customer_id || ' | ' || region || ' | ' || education as customer_info from customers"""
)
def string_ops(spark, sf_dir):
    return projections.describe_in_text(customers(spark, sf_dir)).select(
        "customer_id", "region", "region_upper", "education_length", "initials", "customer_info"
    )


@query(
    T_SQL
    + r"""
select distinct merchant, regexp_extract(merchant, 'Merchant_(\d+)', 1) as merchant_number,
       case when try_cast(regexp_extract(merchant, 'Merchant_(\d+)', 1) as integer) < 100 then 'Small'
            when try_cast(regexp_extract(merchant, 'Merchant_(\d+)', 1) as integer) < 500 then 'Medium'
            else 'Large' end as merchant_category,
       regexp_replace(merchant, '_', ' ', 'g') as clean_merchant
from transactions"""
)
def merchant_patterns(spark, sf_dir):
    return projections.merchant_patterns(transactions(spark, sf_dir))


@query(
    T_SQL
    + """
select transaction_id, cast(year(transaction_date) as integer) as year, cast(month(transaction_date) as integer) as month,
       cast(date '2001-08-02' - transaction_date as integer) as days_ago,
       strftime(transaction_date, '%a') as weekday, cast(isodow(transaction_date) as integer) as iso_weekday
from transactions"""
)
def date_parts(spark, sf_dir):
    when = F.col("transaction_date")
    return transactions(spark, sf_dir).select(
        "transaction_id",
        F.year(when).alias("year"),
        F.month(when).alias("month"),
        dates.days_since(when, F.lit("2001-08-02").cast("date")).alias("days_ago"),
        dates.weekday_name(when).alias("weekday"),
        dates.iso_weekday(when).alias("iso_weekday"),
    )


@query(
    """
select l_orderkey, l_linenumber, l_partkey, round(abs(l_discount - l_tax), 6) as difference,
       l_orderkey % 100 as remainder, round(l_extendedprice / nullif(l_discount, 0), 4) as ratio,
       round(l_extendedprice * (1 - l_discount), 4) as net, round(ln(1 + l_quantity), 8) as log_quantity
from lineitem"""
)
def math_ops(spark, sf_dir):
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round(F.abs(discount - F.col("l_tax")), 6).alias("difference"),
        (F.col("l_orderkey") % 100).alias("remainder"),
        F.round(F.try_divide(price, discount), 4).alias("ratio"),
        F.round(price * (1 - discount), 4).alias("net"),
        F.round(F.log1p("l_quantity"), 8).alias("log_quantity"),
    )


@query(
    """
select word, count(*) as occurrences
from (select unnest(string_split(lower(trim(coalesce(text, ''))), ' ')) as word from documents) group by word"""
)
def text_tokens(spark, sf_dir):
    return projections.word_counts(table(spark, sf_dir, "documents"), "text")


@query(
    """
select conv_id, turn, ltrim(text) as left_trimmed, rtrim(text) as right_trimmed,
       lower(role) as role, coalesce(nullif(role, 'system'), 'none') as speaker
from conversations"""
)
def text_trims(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.ltrim("text").alias("left_trimmed"),
        F.rtrim("text").alias("right_trimmed"),
        F.lower("role").alias("role"),
        F.coalesce(F.nullif(F.col("role"), F.lit("system")), F.lit("none")).alias("speaker"),
    )


@query(
    """
select event_id, cast(cast(ts as date) + 30 as varchar) as plus_30, cast(cast(ts as date) - 7 as varchar) as minus_7,
       cast(hour(ts) as integer) as hour, cast(day(ts) as integer) as day_of_month,
       cast(floor(epoch(ts)) as bigint) as seconds, strftime(ts, '%Y-%m-%d %H:%M:%S') as written
from events"""
)
def event_time_parts(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.date_add(ts, 30).cast("string").alias("plus_30"),
        F.date_sub(ts, 7).cast("string").alias("minus_7"),
        F.hour(ts).alias("hour"),
        F.dayofmonth(ts).alias("day_of_month"),
        F.unix_timestamp(ts.cast("timestamp")).alias("seconds"),
        F.from_unixtime(F.unix_timestamp(ts.cast("timestamp"))).alias("written"),
    )


@query(
    """
select event_id, event_type || '/' || cast(user_id as varchar) as pair, '[' || user_id || ',' || event_id || ']' as ids,
       'type,props' as keys, event_type || ',' || props as entries
from events"""
)
def nested_build(spark, sf_dir):
    built = table(spark, sf_dir, "events").select(
        "event_id",
        F.struct("event_type", "user_id").alias("who"),
        F.array("user_id", "event_id").alias("numbers"),
        F.create_map(F.lit("type"), F.col("event_type"), F.lit("props"), F.col("props")).alias("facts"),
    )
    return built.select(
        "event_id",
        F.concat_ws("/", "who.event_type", F.col("who.user_id").cast("string")).alias("pair"),
        F.concat(F.lit("["), F.array_join(F.col("numbers").cast("array<string>"), ","), F.lit("]")).alias("ids"),
        F.array_join(F.map_keys("facts"), ",").alias("keys"),
        F.array_join(F.map_values("facts"), ",").alias("entries"),
    )


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem")
def columns_by_type(spark, sf_dir):
    chosen = projections.columns_of_type(table(spark, sf_dir, "lineitem"), T.IntegralType)
    return chosen.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
