"""Customer master list: routes, coverage, classification, supervisor, new flag."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline import params as P
from ledgerline.functions import default_if_blank, in_values, ne_keep_null, parse_created_date, route_parts
from ledgerline.operators import drop_incomplete, first_per_key, lookup
from ledgerline.params import Params

CUSTOMER_MASTER_COLS = [
    "branch", "classification", "supervisor", "channel", "rep_id", "rep_name", "customer_id", "customer_name",
    "barangay", "city", "province", "status", "retail_env", "customer_class", "coverage_day", "coverage_weeks",
    "freq_count", "freq", "is_new",
]


def route_coverage(route: DataFrame) -> DataFrame:
    """``(customer_id, coverage_day, coverage_weeks, freq)`` decoded from route codes."""
    return route.select("customer_id", route_parts("route_code").alias("r")).select("customer_id", "r.*")


def customer_master(refs: Mapping[str, DataFrame], params: Params, keep_created: bool = False) -> DataFrame:
    """One row per customer.

    Blocked customers get ``NA`` coverage; active ones count 1 visit; customers on
    approval hold are removed (missing status kept). Duplicate customer rows (from
    the extract or from several routes) keep the earliest parsable created date,
    ties broken on the other columns.
    """
    cust = refs["customer"].select(
        "branch", "channel", "rep_id", "rep_name", "customer_id", "customer_name", "barangay", "city",
        "province", "status", "retail_env", "customer_class", "created",
    )
    cml = lookup(cust, route_coverage(refs["route"]), "customer_id")
    blocked = F.coalesce(F.col("status") == F.lit(P.BLOCKED_STATUS), F.lit(False))
    na = F.lit(P.BLOCKED_ROUTE_TEXT)
    cml = cml.withColumns({
        "coverage_day": F.when(blocked, na).otherwise(F.col("coverage_day")),
        "coverage_weeks": F.when(blocked, na).otherwise(F.col("coverage_weeks")),
        "freq": F.when(blocked, na).otherwise(F.col("freq")),
        "freq_count": F.when(F.col("status") == F.lit(P.ACTIVE_STATUS), F.lit(1)).otherwise(F.lit(0)).cast("bigint"),
    }).filter(ne_keep_null("status", P.ON_HOLD_STATUS))
    classes = drop_incomplete(refs["classification"].select("customer_class", "classification"))
    cml = lookup(cml, classes, "customer_class", ["classification"])
    if params.special_customers:
        cml = cml.withColumn(
            "classification",
            F.when(in_values("customer_id", params.special_customers), F.lit(P.SPECIAL_CLASSIFICATION))
            .otherwise(F.col("classification")),
        )
    sup = drop_incomplete(refs["supervisor"].select("rep_id", "supervisor"))
    cml = lookup(cml, sup, "rep_id", ["supervisor"])
    cml = lookup(cml, refs["new_customer"].select("customer_id", "is_new"), "customer_id", ["is_new"])
    cml = cml.withColumn("is_new", default_if_blank("is_new", P.NEW_CUSTOMER_DEFAULT))
    cml = cml.withColumn("created_on", parse_created_date("created")).drop("created")
    out = first_per_key(cml.select(*CUSTOMER_MASTER_COLS, "created_on"), ["customer_id"], ["created_on"])
    return out.select(*CUSTOMER_MASTER_COLS, *(["created_on"] if keep_created else []))
