"""Column functions over prices, payment plans and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lookups as L

#: Annual discount rate of what is still owed; months between payments.
RATE, INTERVAL = 0.20, 3


def present_value_factor(months: Column, rate: float = RATE) -> Column:
    """Value today of 1 paid in equal quarterly instalments over some months: a geometric sum in closed form."""
    n = F.greatest(F.lit(1.0), F.bround(months / INTERVAL))
    q = F.pow(F.lit(1 + rate), -(months / n / 12))
    return F.when(months == 0, F.lit(1.0)).otherwise(q * (1 - F.pow(q, n)) / (1 - q) / n)


def payment_terms(price: Column, down: Column, months: Column, instalments: Column, cash_if_no_plan: Column) -> Column:
    """terms, cash_equivalent, remaining, remaining_share, years, discount of a price."""
    owed = F.greatest(F.lit(0.0), price - down)
    present = down + owed * present_value_factor(months)
    names = ("terms", "cash_equivalent", "remaining", "remaining_share", "years", "discount")
    row = lambda *v: F.struct(*((x if isinstance(x, Column) else F.lit(x)).cast("string" if n == "terms" else "double").alias(n) for n, x in zip(names, v, strict=True)))  # noqa: E731, E501
    plan = row("plan", F.bround(present), F.bround(owed), F.bround(owed / price, 4), F.bround(months / 12, 1), F.bround(1 - present / price, 4))
    is_plan = F.coalesce(instalments, F.lit(False))
    return (
        F.when(is_plan & down.isNotNull() & (F.coalesce(months, F.lit(0)) != 0), plan)
        .when(is_plan, row("partial", None, None, None, None, None))
        .when(cash_if_no_plan, row("cash", F.bround(price), 0, 0, 0, 0))
        .otherwise(row("unknown", None, None, None, None, None))
    )


def delivery(date: Column, status: Column, today: Column) -> Column:
    """bucket and years until the promised handover; a date that cannot be read leaves it to the status."""
    years = F.date_diff(F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd"), today) / 365.25
    bucket = F.when(years <= 0, "ready").when(years <= 1, "under_1y").when(years <= 2, "1_2y").when(years <= 3, "2_3y").when(years.isNotNull(), "3y_plus")
    ready = F.lower(F.coalesce(status, F.lit(""))).isin(*L.READY)
    return F.struct(F.coalesce(bucket, F.when(ready, "ready"), F.lit("unknown")).alias("bucket"), (F.bround(years, 2) + F.lit(0.0)).alias("years"))


def plan_bucket(terms: Column, years: Column) -> Column:
    return F.when(terms.isin("cash", "unknown"), "cash").when(years.isNull(), "unknown").when(years < 3, "under_3y").when(years < 6, "3_6y").when(years < 9, "6_9y").otherwise("9y_plus")


def signing(price: Column, remaining: Column) -> Column:
    """What is paid at signing; null where it is not known what is owed."""
    return price - remaining


def quarterly(remaining: Column, years: Column, terms: Column) -> Column:
    return F.when((terms == "plan") & (years > 0), remaining / (years * 4))


def since_contract(year: Column, contract_ppm: Column, developer_ppm: Column, today: Column) -> Column:
    """change and annual change of a list price since a contract of some year (counted from 1 July)."""
    change = developer_ppm / contract_ppm - 1
    years = F.date_diff(today, F.make_date(year, F.lit(7), F.lit(1))) / 365.25
    annual = F.when((years >= 1) & (change > -1), F.pow(1 + change, 1 / years) - 1)
    known = year.isNotNull() & (year != 0) & (year <= F.year(today))
    return F.when(known, F.struct(year.alias("year"), F.bround(change, 4).alias("change"), F.bround(annual, 4).alias("annual")))


# Fees of a purchase as shares of its headline price; nothing is put aside for maintenance of a home that is ready.
FEES = {"transfer": 0.05, "brokerage": 0.025, "maintenance": 0.08, "registration": 0.0}


def costs(price: Column, remaining: Column, cash: Column, ready: Column, fees: dict[str, float] = FEES) -> Column:
    """What leaves the buyer's account: at_signing, later, in today's money (all_in), and the fees' share of that."""
    own = {k: price * v for k, v in fees.items()}
    own["maintenance"] = F.when(ready, F.lit(0.0)).otherwise(own["maintenance"])
    due, owed = own["transfer"] + own["brokerage"] + own["registration"], F.coalesce(remaining, F.lit(0.0))
    all_in = F.coalesce(cash, price) + due + own["maintenance"]
    return F.struct((price - owed + due).alias("at_signing"), (owed + own["maintenance"]).alias("later"), all_in.alias("all_in"), F.bround((due + own["maintenance"]) / all_in, 4).alias("fee_share"))


def backoff(attempt: Column) -> Column:
    """Seconds before another attempt (from 0): 3, 9, 27, at most 60."""
    return F.least(F.lit(60), F.lit(3) * F.pow(F.lit(3), attempt)).cast("int")


def iso_date(value: Column) -> Column:
    """An ISO date and time as UTC text with a Z; without a zone it is UTC already; null where it is none."""
    ok = value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$")
    value = F.regexp_replace(value, r"([T ]\d{2}:\d{2})(Z|[+-]|$)", "$1:00$2")
    zoned = F.when(value.rlike(r"(Z|[+-]\d{2}:\d{2})$") & value.rlike(r"\d{2}:\d{2}"), value).when(F.length(value) == 10, F.concat(value, F.lit("T00:00:00Z"))).otherwise(F.concat(value, F.lit("Z")))
    at = F.when(ok, zoned.try_cast("timestamp"))
    utc = F.convert_timezone(F.expr("current_timezone()"), F.lit("UTC"), at.cast("timestamp_ntz"))
    return F.concat(F.regexp_replace(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", ""), F.lit("Z"))


def scheduled_run(at: Column) -> Column:
    """The name of the nightly run that an instant starts: 02:30 in Cairo, whatever the season; else null."""
    local = F.convert_timezone(F.expr("current_timezone()"), F.lit("Africa/Cairo"), at.cast("timestamp_ntz"))
    return F.when(F.date_format(local, "HH:mm") == "02:30", F.concat(F.lit("nightly-"), F.date_format(local, "yyyy-MM-dd")))


def instalment_months(years: Column, balance: Column, instalment: Column, every: Column) -> Column:
    """Months of a plan: the published years if at most 15, else the payments that the balance takes, if at most 120."""
    paid = F.ceil(F.try_divide(balance, instalment)) * every
    return F.coalesce(F.when((years > 0) & (years <= 15), F.bround(years * 12).cast("int")), F.when((instalment > 0) & (paid > 0) & (paid <= 120), paid.cast("int")))
