"""The driver's tables as a raw text layer, and as a typed cleaned layer.

The tables are clean, so the raw layer is written the way untidy exports are: float
artefacts and blanks in keys, padded text, several date formats, thousands
separators. Which blemish a row gets follows from its own status, flag or segment.
Whole tables go in; no row is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.config import Checks, CleaningPolicy, Relation

col, lit, when = F.col, F.lit, F.when


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(name: str) -> Column:
    return col(name).cast("string")


def _plus(name: str, after: str = "", before: str = "") -> Column:
    return F.concat(lit(before), _text(name), lit(after))


def _cents(name: str, before: str = "") -> Column:
    return F.concat(lit(before), col(name).cast("decimal(18,2)").cast("string"))


def _day(name: str, pattern: str) -> Column:
    return F.date_format(col(name).cast("date"), pattern)


def _thousands(name: str) -> Column:
    return F.format_number(name, 2)


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        when(segment == "BUILDING", _plus("c_custkey", ".0"))
        .when(segment == "MACHINERY", _plus("c_custkey", before="00"))
        .otherwise(_text("c_custkey"))
        .alias("CustomerID"),
        when(segment == "HOUSEHOLD", _plus("c_name", " ", "  "))
        .otherwise(col("c_name"))
        .alias("CustomerName"),
        when(col("c_acctbal") < 0, "  ").otherwise(_plus("c_nationkey", ".0")).alias("NationID"),
        when(segment == "AUTOMOBILE", _thousands("c_acctbal"))
        .otherwise(_cents("c_acctbal"))
        .alias("AccountBalance"),
        when(col("c_acctbal") < 0, "").otherwise(segment).alias("MarketSegment"),
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority, pending = col("o_orderpriority"), col("o_orderstatus") == "P"
    return table(spark, sf_dir, "orders").select(
        when(pending, _plus("o_orderkey", ".0")).otherwise(_text("o_orderkey")).alias("OrderID"),
        when(priority == "2-HIGH", _plus("o_custkey", ".0"))
        .when(priority == "3-MEDIUM", _plus("o_custkey", ".00"))
        .when((priority == "4-NOT SPECIFIED") & pending, "  ")
        .when((priority == "5-LOW") & pending, _plus("o_custkey", before="X"))
        .when(priority == "5-LOW", _plus("o_custkey", before=" "))
        .otherwise(_text("o_custkey"))
        .alias("CustomerID"),
        col("o_orderstatus").alias("OrderStatus"),
        when(pending, _thousands("o_totalprice"))
        .when(priority == "5-LOW", _cents("o_totalprice", before="-"))
        .otherwise(_cents("o_totalprice"))
        .alias("TotalPrice"),
        when(priority == "1-URGENT", _day("o_orderdate", "yyyy-MM-dd"))
        .when(priority == "2-HIGH", _day("o_orderdate", "MM/dd/yyyy"))
        .when(priority == "3-MEDIUM", _day("o_orderdate", "M/d/yyyy"))
        .when(priority == "4-NOT SPECIFIED", _day("o_orderdate", "dd-MM-yyyy"))
        .otherwise(_day("o_orderdate", "yyyy/MM/dd"))
        .alias("OrderDate"),
        priority.alias("OrderPriority"),
    )


def raw_order_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, status = col("l_returnflag"), col("l_linestatus")
    return table(spark, sf_dir, "lineitem").select(
        when(flag == "R", _plus("l_orderkey", ".0"))
        .when(flag == "N", _plus("l_orderkey", before="0"))
        .otherwise(_text("l_orderkey"))
        .alias("OrderID"),
        when((flag == "A") & (status == "F"), " ")
        .when(status == "O", _plus("l_partkey", ".00"))
        .otherwise(_text("l_partkey"))
        .alias("PartID"),
        when((flag == "N") & (status == "O"), _plus("l_suppkey", before="S"))
        .otherwise(_text("l_suppkey"))
        .alias("SupplierID"),
        _text("l_linenumber").alias("LineNumber"),
        when(flag == "R", _cents("l_quantity", before="-"))
        .otherwise(_cents("l_quantity"))
        .alias("Quantity"),
        when(status == "O", _thousands("l_extendedprice"))
        .otherwise(_cents("l_extendedprice"))
        .alias("ExtendedPrice"),
        when(status == "O", _day("l_shipdate", "dd/MM/yyyy"))
        .otherwise(_day("l_shipdate", "MM/dd/yyyy"))
        .alias("ShipDate"),
    )


def raw_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        _text("p_partkey").alias("PartID"),
        col("p_name").alias("PartName"),
        when(col("p_type") == "ECONOMY", "").otherwise(col("p_brand")).alias("Brand"),
        col("p_type").alias("Type"),
        _text("p_size").alias("Size"),
        _cents("p_retailprice").alias("RetailPrice"),
    )


def raw_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        _plus("s_suppkey", ".0").alias("SupplierID"),
        col("s_name").alias("SupplierName"),
        _text("s_nationkey").alias("NationID"),
        _cents("s_acctbal").alias("AccountBalance"),
    )


def raw_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        _text("n_nationkey").alias("NationID"),
        col("n_name").alias("NationName"),
        _text("n_regionkey").alias("RegionID"),
    )


def raw_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        _text("r_regionkey").alias("RegionID"), col("r_name").alias("RegionName")
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        _text("event_id").alias("EventID"),
        _day("ts", "yyyy-MM-dd").alias("EventDate"),
        _text("user_id").alias("UserID"),
        when(col("event_type") == "error", " ").otherwise(col("event_type")).alias("EventType"),
        _cents("value").alias("Value"),
        col("props").alias("Props"),
    )


def raw_layer(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "customers": raw_customers(spark, sf_dir),
        "events": raw_events(spark, sf_dir),
        "nations": raw_nations(spark, sf_dir),
        "order_details": raw_order_details(spark, sf_dir),
        "orders": raw_orders(spark, sf_dir),
        "parts": raw_parts(spark, sf_dir),
        "regions": raw_regions(spark, sf_dir),
        "suppliers": raw_suppliers(spark, sf_dir),
    }


CHECKS = Checks(
    primary_keys={
        "customers": "customer_id",
        "events": "event_id",
        "nations": "nation_id",
        "order_details": ["order_id", "line_number"],
        "orders": "order_id",
        "parts": "part_id",
        "regions": "region_id",
        "suppliers": "supplier_id",
    },
    dates={"events": ["event_date"], "order_details": ["ship_date"], "orders": ["order_date"]},
    numbers={
        "customers": ["account_balance"],
        "events": ["value"],
        "order_details": ["quantity", "extended_price"],
        "orders": ["total_price"],
        "parts": ["size", "retail_price"],
        "suppliers": ["account_balance"],
    },
    relations=(
        Relation("customers", "nation_id", "nations", "nation_id"),
        Relation("nations", "region_id", "regions", "region_id"),
        Relation("order_details", "order_id", "orders", "order_id"),
        Relation("order_details", "part_id", "parts", "part_id"),
        Relation("order_details", "supplier_id", "suppliers", "supplier_id"),
        Relation("orders", "customer_id", "customers", "customer_id"),
        Relation("suppliers", "nation_id", "nations", "nation_id"),
    ),
)


def raw_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their first line's ship date, dates as month/day/year text."""
    shipped = (
        table(spark, sf_dir, "lineitem")
        .groupBy(col("l_orderkey").alias("o_orderkey"))
        .agg(F.min("l_shipdate").alias("first_ship"))
    )
    return (
        table(spark, sf_dir, "orders")
        .join(shipped, "o_orderkey", "left")
        .select(
            _plus("o_orderkey", ".0").alias("OrderID"),
            _text("o_custkey").alias("CustomerID"),
            when(col("o_orderpriority") == "5-LOW", _day("o_orderdate", "yyyy/MM/dd"))
            .otherwise(_day("o_orderdate", "M/d/yyyy"))
            .alias("OrderDate"),
            when(col("o_orderstatus") == "P", "  ")
            .otherwise(_day("first_ship", "MM/dd/yyyy"))
            .alias("ShipDate"),
            _thousands("o_totalprice").alias("FreightCharge"),
        )
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products whose colour is missing for one type."""
    return table(spark, sf_dir, "part").select(
        _text("p_partkey").alias("ProductID"),
        col("p_name").alias("ProductName"),
        when(col("p_type") != "ECONOMY", F.split_part(col("p_name"), lit(" "), lit(1))).alias(
            "Color"
        ),
        _thousands("p_retailprice").alias("PurchasePrice"),
    )


CLEANING = CleaningPolicy(money={"orders": ["freight_charge"], "products": ["purchase_price"]})

FACT_POLICY = CleaningPolicy(
    money={
        "orders": ["freight_charge"],
        "order_details": ["unit_sales_price"],
        "payments": ["payment_amount"],
    },
    integers={"customers": ["discontinued"], "order_details": ["quantity_sold"]},
)


def cleaning_input(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"orders": raw_shipments(spark, sf_dir), "products": raw_products(spark, sf_dir)}


def fact_input(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Typed cleaned layer for the order fact.

    An order ships with its first line; lines with status F stand in for payments.
    """
    lines = table(spark, sf_dir, "lineitem")
    shipped = lines.groupBy(col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_shipdate").cast("date").alias("ship_date")
    )
    order_date = col("o_orderdate").cast("date")
    lead = F.datediff("ship_date", order_date)
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), col("n_regionkey") == col("r_regionkey")
    )
    return {
        "customers": table(spark, sf_dir, "customer")
        .join(places, col("c_nationkey") == col("n_nationkey"), "left")
        .select(
            col("c_custkey").alias("customer_id"),
            col("c_name").alias("customer_name"),
            col("r_name").alias("region"),
            col("n_name").alias("country"),
            col("c_mktsegment").alias("customer_class"),
            col("c_nationkey").alias("price_category"),
            when(col("c_acctbal") < 0, 1).otherwise(0).alias("discontinued"),
        ),
        "orders": table(spark, sf_dir, "orders")
        .join(shipped, "o_orderkey", "left")
        .select(
            col("o_orderkey").alias("order_id"),
            col("o_custkey").alias("customer_id"),
            order_date.alias("order_date"),
            "ship_date",
            col("o_totalprice").cast("decimal(18,2)").alias("freight_charge"),
            lead.alias("ship_lead_days"),
            F.coalesce(lead < 0, lit(False)).alias("is_orderdate_gt_shipdate"),
        ),
        "order_details": lines.select(
            col("l_orderkey").alias("order_id"),
            col("l_quantity").cast("int").alias("quantity_sold"),
            col("l_extendedprice").cast("decimal(18,2)").alias("unit_sales_price"),
        ),
        "payments": lines.where(col("l_linestatus") == "F").select(
            col("l_orderkey").alias("order_id"),
            col("l_extendedprice").cast("decimal(18,2)").alias("payment_amount"),
        ),
    }
