"""Unit economics, inventory, profit and cash over (scenario, sku, month)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import excel_round, excel_roundup, safe_div


@dataclass(frozen=True)
class Rates:
    """Assumptions shared by all goods."""

    agent: float = 0.05
    bank: float = 0.01
    per_kg: float = 250.0
    per_m3: float = 30000.0
    batch_fee: float = 15000.0
    inbound_per_kg: float = 10.0
    return_cost: float = 50.0
    ads: float = 0.08
    fixed: float = 150000.0
    tax: str = "turnover"  # turnover, margin, professional
    tax_turnover: float = 0.06
    tax_margin: float = 0.15
    tax_floor: float = 0.01
    tax_professional: float = 0.06


def scenario_drivers(scenarios: DataFrame, fx: float, ads: float) -> DataFrame:
    """fx, price and sales multipliers and the advertising share (not below 0) of scenarios
    (scenario, d_fx, d_price, d_sales, d_ads)."""
    return scenarios.select("scenario", (fx * (1 + F.col("d_fx"))).alias("fx"), (1 + F.col("d_price")).alias("price_mult"), (1 + F.col("d_sales")).alias("sales_mult"), F.greatest(F.lit(0.0), ads + F.col("d_ads")).alias("ads"))


def unit_economics(skus: DataFrame, drivers: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """Cost, tax and profit of one sold unit for every good in every scenario.

    ``skus``: sku, price_cny, weight_kg, volume_m3, batch, price_rub, plateau, duty_rate,
    vat_rate, cert, pack, commission, logistics, returns. A result that is undefined
    for goods without profit is null, with the reason in its status column.
    """
    c = F.col
    x = skus.crossJoin(F.broadcast(drivers))
    x = x.withColumns({"price": c("price_rub") * c("price_mult"), "goods": c("price_cny") * c("fx")})
    x = x.withColumn("agent", c("goods") * rates.agent).withColumn("bank", (c("goods") + c("agent")) * rates.bank)
    x = x.withColumn("freight", F.greatest(c("weight_kg") * rates.per_kg, c("volume_m3") * rates.per_m3))
    x = x.withColumn("duty", (c("goods") + c("freight")) * c("duty_rate")).withColumn("vat", (c("goods") + c("freight") + c("duty")) * c("vat_rate"))
    x = x.withColumns({"customs_fee": safe_div(F.lit(rates.batch_fee), c("batch")), "inbound": c("weight_kg") * rates.inbound_per_kg, "pay_order": c("goods") + c("agent") + c("bank")})
    x = x.withColumn("landed", c("pay_order") + c("freight") + c("duty") + c("vat") + c("customs_fee") + c("pack") + c("inbound"))
    x = x.withColumns({"fee": c("price") * c("commission"), "shipping": (c("logistics") + c("returns") * rates.return_cost) / (1 - c("returns")), "ads_unit": c("price") * c("ads")})
    x = x.withColumn("pretax", c("price") - c("landed") - c("fee") - c("shipping") - c("ads_unit"))
    tax = {"turnover": c("price") * rates.tax_turnover, "margin": F.greatest(c("pretax") * rates.tax_margin, c("price") * rates.tax_floor), "professional": c("price") * rates.tax_professional}[rates.tax]
    x = x.withColumn("tax", tax).withColumn("profit", c("pretax") - c("tax"))
    # The whole of a scenario is summed in the map tasks and joined back: one row a scenario.
    whole = x.groupBy(c("scenario").alias("_scenario")).agg(F.sum(c("price") * c("plateau")).alias("_whole"))
    x = x.join(whole, c("scenario") == c("_scenario")).withColumn("rev_share", safe_div(c("price") * c("plateau"), c("_whole"))).drop("_scenario", "_whole")
    paid = c("profit") > 0
    return x.withColumns(
        {
            "margin": safe_div(c("profit"), c("price")),
            "markup": safe_div(c("price") - c("landed"), c("landed")),
            "roi": safe_div(c("profit"), c("landed")),
            "plateau_eff": c("plateau") * c("sales_mult"),
            "break_even": F.when(paid, rates.fixed * c("rev_share") / c("profit")),
            "break_even_status": F.when(paid, "ok").otherwise("loss per unit"),
            "cert_payback": F.when(paid, c("cert") / c("profit")),
        }
    )


def inventory_plan(demand: DataFrame, keys: list[str], lead: int, safety: int) -> DataFrame:
    """Month by month arrivals, sales, stock and orders of every key.

    ``demand``: keys, month (1 to N), demand, batch, start_stock; a month that is not given has
    no demand. Orders depend on stock and on orders under way, so a fold walks the months of a key:
    one short array of the key's horizon, never more. What the horizon does not show is taken as the last month.
    """
    c = F.col
    series = demand.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(c("month").cast("int"), c("demand").cast("double")))).alias("s"), F.max("month").cast("int").alias("n"), F.max("batch").cast("double").alias("batch"), F.max("start_stock").cast("double").alias("start"))
    series = series.withColumn("d", F.transform(F.sequence(F.lit(1), c("n")), lambda m: F.coalesce(F.try_element_at("s", m), F.lit(0.0))))
    empty = F.struct(F.array().cast("array<struct<month:int,demand:double,arrivals:double,sales:double,stock:double,transit:double,need:double,orders:double>>").alias("rows"), c("start").alias("stock"))

    def step(acc: Column, t: Column) -> Column:
        rows = acc["rows"]
        order_at = lambda m: F.coalesce(F.get(rows, m - 1)["orders"], F.lit(0.0))
        wanted = F.get(c("d"), t - 1)
        arrived = F.when(t > lead, order_at(t - lead)).otherwise(0.0)
        sold = F.least(wanted, acc["stock"] + arrived)
        left = acc["stock"] + arrived - sold
        under_way = F.aggregate(F.filter(rows, lambda r: r["month"] > t - lead), F.lit(0.0), lambda a, r: a + r["orders"])
        ahead = F.aggregate(F.slice(c("d"), t + 1, F.lit(lead + safety)), F.lit(0.0), lambda a, x: a + x)
        tail = F.greatest(F.lit(0), t + (lead + safety) - c("n")) * F.get(c("d"), c("n") - 1)
        gap = ahead + tail - left - under_way
        ordered = F.when(gap > 0, excel_roundup(gap / c("batch")) * c("batch")).otherwise(0.0)
        row = F.struct(t.alias("month"), wanted.alias("demand"), arrived.alias("arrivals"), sold.alias("sales"), left.alias("stock"), under_way.alias("transit"), (ahead + tail).alias("need"), ordered.alias("orders"))
        return F.struct(F.concat(rows, F.array(row)).alias("rows"), left.alias("stock"))

    plan = series.withColumn("p", F.aggregate(F.sequence(F.lit(1), c("n")), empty, step))
    return plan.select(*keys, F.explode("p.rows").alias("r")).select(*keys, "r.*")


def ramp_demand(plateau: Column, ramp: Column, multiplier: Column) -> Column:
    return excel_round(plateau * ramp * multiplier, 0)


def running_tax(monthly: DataFrame, keys: list[str], year: str, month: str, base: str, rate: float) -> DataFrame:
    """Year-to-date base, its tax, and the month's tax as the growth of it."""
    so_far = Window.partitionBy(*keys, year).orderBy(month).rowsBetween(Window.unboundedPreceding, 0)
    by_month = Window.partitionBy(*keys, year).orderBy(month)
    out = monthly.withColumn("ytd_base", F.sum(base).over(so_far)).withColumn("ytd_tax", F.greatest(F.lit(0.0), F.col("ytd_base") * rate))
    return out.withColumn("tax", F.col("ytd_tax") - F.lag("ytd_tax", 1, 0.0).over(by_month))


def month_number(year: Column, month: Column) -> Column:
    """Months since the year 0, so that neighbouring months differ by one."""
    return year * 12 + month - 1


def dense_months(monthly: DataFrame, keys: list[str], order: str, zero: list[str]) -> DataFrame:
    """``monthly`` with a row for each month between the first and the last one of a key.

    ``order`` numbers months (``month_number``). In added rows the columns in ``zero`` are 0, the others null.
    """
    ends = monthly.groupBy(*keys).agg(F.min(order).alias("_a"), F.max(order).alias("_z"))
    spine = ends.select(*keys, F.explode(F.sequence("_a", "_z")).alias(order))
    return spine.join(monthly, [*keys, order], "left").fillna(0, subset=zero).select(*monthly.columns)


def cash_flow(monthly: DataFrame, keys: list[str], order: str, income: str, tax: str, month: str, days: int, start: float) -> DataFrame:
    """Payouts that arrive after ``days``, quarterly tax payments, and the cash they leave.

    ``order`` numbers months without a gap in time (``month_number``): months without a row are
    added with no income and no tax, so that a payout or a quarter never moves to a later month. Adds
    payout, tax_paid, flow, cash (running, from ``start``) and lowest_ahead (the smallest cash of this and all later months).
    """
    monthly = dense_months(monthly, keys, order, [income, tax]).withColumn(month, F.coalesce(F.col(month), (F.col(order) % 12 + 1).cast("int")))
    line = Window.partitionBy(*keys).orderBy(order)
    whole, part = days // 30, days % 30 / 30
    quarter = line.rowsBetween(-3, -1)
    out = monthly.withColumn("payout", (1 - part) * F.lag(income, whole, 0.0).over(line) + part * F.lag(income, whole + 1, 0.0).over(line))
    out = out.withColumn("tax_paid", F.when(F.col(month) % 3 == 1, F.coalesce(F.sum(tax).over(quarter), F.lit(0.0))).otherwise(0.0))
    out = out.withColumn("flow", F.col("payout") - F.col("tax_paid"))
    out = out.withColumn("cash", start + F.sum("flow").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("lowest_ahead", F.min("cash").over(line.rowsBetween(0, Window.unboundedFollowing)))


def sensitivity(skus: DataFrame, rates: Rates, fx_axis: list[float], price_axis: list[float]) -> DataFrame:
    """Total plateau profit on a grid of exchange rates and price changes; the grid is one more key."""
    spark = skus.sparkSession
    grid = spark.createDataFrame([(f"{a}|{b}", float(a), 1 + float(b), 1.0, rates.ads, float(a), float(b)) for a in fx_axis for b in price_axis], "scenario string, fx double, price_mult double, sales_mult double, ads double, axis_fx double, axis_price double")
    unit = unit_economics(skus, grid, rates)
    return unit.groupBy("axis_fx", "axis_price").agg(F.sum(F.col("profit") * F.col("plateau_eff")).alias("profit"))


def certification(plan: DataFrame, keys: list[str], month: str, orders: str, cost: str) -> DataFrame:
    """``plan`` with ``cert``: the cost of certification in the month of the first order of a key."""
    earlier = Window.partitionBy(*keys).orderBy(month).rowsBetween(Window.unboundedPreceding, -1)
    first = (F.col(orders) > 0) & (F.coalesce(F.sum(orders).over(earlier), F.lit(0.0)) == 0)
    return plan.withColumn("cert", F.when(first, F.col(cost)).otherwise(0.0))


def running_profit(monthly: DataFrame, keys: list[str], order: str, net: str, revenue: str) -> DataFrame:
    """``monthly`` with ``net_cum`` (profit so far) and ``net_margin``."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return monthly.withColumns({"net_cum": F.sum(net).over(so_far), "net_margin": safe_div(F.col(net), F.col(revenue))})


def project_kpis(monthly: DataFrame, keys: list[str], order: str, revenue: str, net: str, cash: str, start: float) -> DataFrame:
    """One row for each key: revenue, net_profit, net_margin, peak_investment, max_gap, first_gap,
    payback (months until the cash never falls below ``start`` again; null: not in the
    horizon), roi and end_cash, of months in the order of ``order``."""
    line = Window.partitionBy(*keys).orderBy(order)
    rows = monthly.withColumns({"_n": F.row_number().over(line), "_low": F.min(cash).over(line.rowsBetween(0, Window.unboundedFollowing))})
    out = rows.groupBy(*keys).agg(
        F.sum(revenue).alias("revenue"),
        F.sum(net).alias("net_profit"),
        F.greatest(F.lit(0.0), F.lit(start) - F.min(cash)).alias("peak_investment"),
        F.greatest(F.lit(0.0), -F.min(cash)).alias("max_gap"),
        F.min(F.when(F.col(cash) < 0, F.col(order))).alias("first_gap"),
        F.min(F.when(F.col("_low") >= start, F.col("_n"))).alias("payback"),
        F.max_by(cash, order).alias("end_cash"),
    )
    return out.withColumns({"net_margin": safe_div(F.col("net_profit"), F.col("revenue")), "roi": safe_div(F.col("net_profit"), F.col("peak_investment"))})


def balance(ends: DataFrame) -> DataFrame:
    """``ends`` (cash, stock_value, transit_value, receivable, tax_payable, start_capital,
    start_stock_value, net_profit) with ``equity``, ``balance_diff`` and ``balance_ok``."""
    c = F.col
    equity = c("cash") + c("stock_value") + c("transit_value") + c("receivable") - c("tax_payable")
    diff = equity - (c("start_capital") + c("start_stock_value") + c("net_profit"))
    return ends.withColumns({"equity": equity, "balance_diff": diff, "balance_ok": excel_round(diff, 2) == 0})
