"""Business questions of a golden corpus as DataFrame queries over the star schema.

``as_of`` stands for today's date, so that relative ranges are reproducible.
Every date condition is a range on the column itself and reaches the scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

AS_OF = dt.date(2001, 7, 15)


def _ntz(value: Column) -> Column:
    return value.cast("timestamp_ntz")


def _day(value: dt.date) -> Column:
    return _ntz(F.lit(value.isoformat()))


def quarter_start(day: dt.date) -> dt.date:
    return day.replace(month=(day.month - 1) // 3 * 3 + 1, day=1)


def months_back(day: dt.date, months: int) -> dt.date:
    index = day.year * 12 + day.month - 1 - months
    year, month = divmod(index, 12)
    last = (dt.date(year + (month == 11), (month + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    return dt.date(year, month + 1, min(day.day, last))


def between_days(frame: DataFrame, column: str, first: dt.date, until: dt.date) -> DataFrame:
    """Half-open date range."""
    return frame.filter((F.col(column) >= _day(first)) & (F.col(column) < _day(until)))


def month_of(column: str) -> Column:
    return _ntz(F.date_trunc("month", column))


def total_count(customer: DataFrame) -> DataFrame:
    return customer.agg(F.count(F.lit(1)).alias("total_members"))


def average_in_year(orders: DataFrame, year: int = 2000) -> DataFrame:
    kept = between_days(orders, "o_orderdate", dt.date(year, 1, 1), dt.date(year + 1, 1, 1))
    return kept.agg(F.round(F.avg("o_totalprice"), 6).alias("avg_price"))


def last_quarter_by_key(orders: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """Last full quarter, not the trailing 90 days."""
    this = quarter_start(as_of)
    kept = between_days(orders, "o_orderdate", quarter_start(months_back(this, 3)), this)
    return kept.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"))


def filtered_count(customer: DataFrame) -> DataFrame:
    return customer.filter(F.col("c_mktsegment") == "BUILDING").agg(F.count(F.lit(1)).alias("active_members"))


def conditional_ratio(orders: DataFrame, quarter: dt.date = dt.date(2000, 1, 1)) -> DataFrame:
    kept = between_days(orders, "o_orderdate", quarter, months_back(quarter, -3))
    return kept.agg(
        F.round(F.try_divide(F.count_if(F.col("o_orderstatus") == "F"), F.count(F.lit(1))), 9).alias("finished_rate")
    )


def net_revenue(lineitem: DataFrame, year: int = 2000) -> DataFrame:
    price = F.col("l_extendedprice")
    kept = between_days(lineitem, "l_shipdate", dt.date(year, 1, 1), dt.date(year + 1, 1, 1))
    return kept.agg(
        F.round(F.sum(price) - F.sum(price * F.col("l_discount")) - F.sum(price * F.col("l_tax")), 2).alias("net_revenue")
    )


def last_two_months(orders: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    this = as_of.replace(day=1)
    kept = between_days(orders, "o_orderdate", months_back(this, 2), this)
    return kept.groupBy(month_of("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n_orders")).orderBy("month")


def top_totals(orders: DataFrame, top: int = 100) -> DataFrame:
    """Totals at order grain, before anything could fan out."""
    totals = orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total_price"))
    return totals.orderBy(F.desc("total_price"), "o_custkey").limit(top)


def never_ordered(customer: DataFrame, orders: DataFrame, since: dt.date = dt.date(2001, 7, 1)) -> DataFrame:
    recent = orders.filter(F.col("o_orderdate") >= _day(since)).select("o_custkey")
    return customer.join(recent, customer.c_custkey == recent.o_custkey, "left_anti").agg(
        F.count(F.lit(1)).alias("never_ordered")
    )


def top_trailing_year(orders: DataFrame, as_of: dt.date = AS_OF, top: int = 10) -> DataFrame:
    kept = orders.filter(F.col("o_orderdate") >= _day(months_back(as_of, 12)))
    counts = kept.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return counts.orderBy(F.desc("n_orders"), "o_custkey").limit(top)


def point_lookup(orders: DataFrame, customer_id: int = 999_999_999) -> DataFrame:
    """A customer that does not exist: no rows, full schema."""
    return orders.filter(F.col("o_custkey") == customer_id).orderBy("o_orderkey").limit(100)


def between_average(orders: DataFrame, year: int = 2000) -> DataFrame:
    first, last = dt.date(year, 1, 1), dt.date(year, 12, 31)
    kept = orders.filter(F.col("o_orderdate").between(_day(first), _day(last)))
    return kept.agg(F.round(F.avg("o_totalprice"), 6).alias("avg_price"))


def daily_counts(orders: DataFrame, since: dt.date = dt.date(2001, 6, 1)) -> DataFrame:
    kept = orders.filter(F.col("o_orderdate") >= _day(since))
    return kept.groupBy(F.to_date("o_orderdate").alias("order_day")).agg(F.count(F.lit(1)).alias("n_orders"))


def monthly_counts(orders: DataFrame, since: dt.date = dt.date(2001, 1, 1)) -> DataFrame:
    kept = orders.filter(F.col("o_orderdate") >= _day(since))
    return kept.groupBy(month_of("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n_orders"))


def projection(part: DataFrame) -> DataFrame:
    return part.select("p_brand", "p_type", "p_retailprice")


def price_by(part: DataFrame, *keys: str) -> DataFrame:
    return part.groupBy(*keys).agg(F.round(F.avg("p_retailprice"), 6).alias("avg_price"))


def month_as_text(orders: DataFrame, since: str = "2001-01") -> DataFrame:
    """Months compared as text; the same bound on the date itself reaches the scan."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    kept = orders.filter(F.col("o_orderdate") >= _day(dt.date.fromisoformat(f"{since}-01")))
    return (
        kept.withColumn("month", month).filter(F.col("month") >= since)
        .groupBy("month").agg(F.round(F.avg("o_totalprice"), 6).alias("avg_price"))
    )


def rate_by_filter(orders: DataFrame) -> DataFrame:
    finished = F.count_if(F.col("o_orderstatus") == "F")
    return orders.agg(F.round(F.try_divide(finished * 1.0, F.count(F.lit(1))), 9).alias("finished_rate"))


def rate_by_case(orders: DataFrame) -> DataFrame:
    finished = F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    return orders.agg(F.round(F.try_divide(finished * 1.0, F.count(F.lit(1))), 9).alias("finished_rate"))


def count_as_rate(orders: DataFrame) -> DataFrame:
    """The wrong answer to a rate question: the bare count under the same name."""
    finished = F.count_if(F.col("o_orderstatus") == "F")
    return orders.agg(finished.cast("double").alias("finished_rate"))


def average_of_segment(customer: DataFrame, segment: str = "MACHINERY") -> DataFrame:
    return customer.filter(F.col("c_mktsegment") == segment).agg(F.round(F.avg("c_acctbal"), 6).alias("avg_balance"))


def column_ratio(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        "l_orderkey", "l_linenumber",
        F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"),
    )


def sum_if_by_month(lineitem: DataFrame) -> DataFrame:
    quantity = F.col("l_quantity")
    return lineitem.groupBy(month_of("l_shipdate").alias("month")).agg(
        F.sum(F.when(F.col("l_linestatus") == "F", quantity).otherwise(0)).alias("finished_quantity"),
        F.sum(quantity).alias("all_quantity"),
    )


def safe_distinct_ratio(orders: DataFrame) -> DataFrame:
    """Distinct customers with an urgent finished order over those with a finished order."""
    month, status = month_of("o_orderdate"), F.col("o_orderstatus") == "F"
    urgent = F.col("o_orderpriority") == "1-URGENT"
    # one row per (month, customer) first: both distinct counts become plain sums
    per_customer = orders.groupBy(month.alias("month"), "o_custkey").agg(
        F.bool_or(status & urgent).alias("_urgent"), F.bool_or(status).alias("_finished")
    )
    return per_customer.groupBy("month").agg(
        F.round(F.try_divide(F.count_if("_urgent"), F.count_if("_finished")), 9).alias("urgent_rate")
    )


def counted_orders(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).cast("double").alias("total_orders"))


def summed_orders(orders: DataFrame) -> DataFrame:
    """The wrong aggregate under the right name."""
    return orders.groupBy("o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total_orders"))
