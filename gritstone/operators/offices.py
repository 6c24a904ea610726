"""Offices out of facts of many pages: one for each name, type and district, with what pages say of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gritstone.functions import fields as X, names as N
from gritstone.functions.text import host
from gritstone.sources.tables import cut

from .naming import longest_match

#: Fixed: keys of a fact's details, and how many different values an office shows.
ADDRESS_KEYS, PHONE_KEYS, EMAIL_KEYS, HOUR_KEYS = ("address", "location", "office_address"), ("phone", "phone_number", "number", "contact"), ("email", "email_id"), ("hours", "working_hours", "timing")
SHOWN = {"address": 4, "phone": 6, "email": 4, "hours": 1, "url": 6}


def _first(detail: Column, keys: tuple[str, ...], clean) -> Column:  # noqa: ANN001
    return F.coalesce(*(clean(F.try_element_at(detail, F.lit(k))) for k in keys))


def _hours(value: Column) -> Column:
    s = F.trim(value)
    return F.when(F.length(s) > 3, s)


def first_values(rows: DataFrame, column: str, most: int) -> DataFrame:
    """id, column (array), n: the first `most` different values of a column by fact_id, and how many there are."""
    each = rows.filter(F.col(column).isNotNull()).groupBy("id", column).agg(F.min("fact_id").alias("at"))
    few = each.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("at", column))).filter(F.col("k") <= most)  # each task keeps `most` of an office
    lists = few.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", column))), lambda x: x[column]).alias(column))
    return lists.join(each.groupBy("id").agg(F.count("*").alias(f"n_{column}")), "id")


def offices(facts: DataFrame, pages: DataFrame, dictionary: DataFrame, root: str = N.ROOT) -> tuple[DataFrame, DataFrame]:
    """(offices, refused) of facts(fact_id, url, object, detail) and pages(url, title).

    An office is id, name, type, scope, status and the first addresses, phones, emails, hours and urls that its facts give, with `conflicting` where pages print more than one address. Its
    name is that of its first EXTRACTED fact, else of its first. A fact without a way to reach the office is UNREACHABLE, one without a name UNNAMED; both are refused. Scopes
    come from the district in the name and address, else from the host, by dictionary(pattern, code, place).
    """
    d = F.col("detail")
    told = facts.join(pages.select("url", "title").dropDuplicates(["url"]), "url", "left").select(
        "fact_id", "url", N.name_of(d, F.col("object"), F.col("title")).alias("named"), _first(d, ADDRESS_KEYS, lambda v: F.when(~v.rlike(N.FIELD_LABEL), X.address(v))).alias("address"),
        _first(d, PHONE_KEYS, X.phone).alias("phone"), _first(d, EMAIL_KEYS, X.email).alias("email"), _first(d, HOUR_KEYS, _hours).alias("hours"),
    )
    reason = F.when(F.coalesce("address", "phone", "email").isNull(), "UNREACHABLE").when(F.col("named").isNull(), "UNNAMED")
    refused = told.select("fact_id", reason.alias("reason")).filter("reason is not null")
    good = told.filter(reason.isNull()).select("fact_id", "url", "named.name", "named.status", "address", "phone", "email", "hours")
    good = good.withColumn("said", F.concat_ws(" ", "name", F.coalesce("address", F.lit("")))).withColumn("host", host(F.col("url")))
    by_text = longest_match(good.select(F.col("said").alias("text")), dictionary, whole_words=True).toDF("said", "by_text")
    by_host = longest_match(good.select(F.col("host").alias("text")), dictionary, whole_words=False).toDF("host", "by_host")
    placed = good.join(by_text, "said", "left").join(by_host, "host", "left").withColumn("scope", F.coalesce("by_text", "by_host", F.lit(root))).withColumn("type", N.office_type(F.col("name")))
    slug = X.name_slug(F.col("name"))
    key = F.left(F.sha1(F.concat_ws("|", F.coalesce("type", F.lit("")), slug, "scope")), F.lit(6))
    rows = cut(placed.withColumn("id", F.concat(F.lit("office:"), slug, F.lit("_"), key)).drop("said", "host", "by_text", "by_host"))  # read once for all lists
    best = F.struct(F.when(F.col("status") == "EXTRACTED", 0).otherwise(1), "fact_id")
    one = rows.groupBy("id").agg(F.min_by(F.struct("name", "status"), best).alias("x"), F.first("type").alias("type"), F.first("scope").alias("scope"), F.count("*").alias("facts"))
    out = one.select("id", X.display(F.col("x.name")).alias("name"), "type", "scope", "x.status", "facts")
    for column, most in SHOWN.items():
        out = out.join(first_values(rows, column, most), "id", "left")
    return out.withColumn("conflicting", F.coalesce(F.col("n_address") > 1, F.lit(False))).drop(*(f"n_{c}" for c in SHOWN if c != "address")), refused
