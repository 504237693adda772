"""Spark queries by name, each over the whole tables of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.config import CleaningPolicy
from assayer.functions.dates import lead_days, parse_date_strict, parse_date_us
from assayer.functions.keys import norm_id, normalize_key
from assayer.functions.labels import merged_label, value_label
from assayer.functions.numbers import parse_money, parse_number_strict
from assayer.functions.sql import register_functions
from assayer.operators import checks, cleaning, exceptions, heavy, maintenance, orders, profiling, relations, running
from assayer.operators.scoring import score
from assayer.operators.shaping import union_all
from assayer.operators.staging import register_views, snake_names, stage_layer, stage_table
from assayer.plans.cleaning import clean_layer, cleaning_report, load_clean
from assayer.plans.continued import extend_windows
from assayer.plans.incremental import add_load, merged_scorecard
from assayer.plans.scorecard import export_fk_detail, export_scorecard, merge_metrics, scorecard
from assayer.session import ensure_checkpoint_dir
from assayer.sources import buckets
from assayer.sources.csv import NULL_MARK, load_layer
from assayer.sources.sinks import (
    read_layer,
    write_csv,
    write_dictionaries,
    write_layer,
    write_report,
    write_sorted,
)
from gate import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Registers under the function's name; a trailing _ avoids clashes with imports."""
    QUERIES[build.__name__.rstrip("_")] = build
    return build


def _staged(spark, sf_dir):
    return stage_layer(inputs.raw_layer(spark, sf_dir))


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- order analytics ------------------------------------------------------------


@query
def order_fact(spark, sf_dir):
    return orders.order_fact(inputs.fact_input(spark, sf_dir))


@query
def order_fact_any_lead(spark, sf_dir):
    """All orders that ship on or after their date, however late."""
    return orders.order_fact(inputs.fact_input(spark, sf_dir), lead=(0, 100_000))


@query
def order_fact_heavy_customers(spark, sf_dir):
    """The same fact planned for customers too large for one task."""
    return orders.order_fact(inputs.fact_input(spark, sf_dir), lead=(0, 100_000), split_customers=True)


@query
def order_fact_without_returns(spark, sf_dir):
    """Returned lines are no sales, so some orders that shipped have no line."""
    clean = inputs.fact_input(spark, sf_dir)
    sold = inputs.table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_quantity").cast("int").alias("quantity_sold"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("unit_sales_price"),
    )
    return orders.order_fact(clean | {"order_details": sold}, lead=(0, 100_000))


@query
def credible_orders(spark, sf_dir):
    return orders.surviving_orders(inputs.fact_input(spark, sf_dir), lead=(0, 100_000))


@query
def line_totals(spark, sf_dir):
    clean = inputs.fact_input(spark, sf_dir)
    survivors = orders.surviving_orders(clean, (0, 100_000))
    return orders.line_totals(orders.rows_of(clean["order_details"], survivors))


@query
def payment_totals(spark, sf_dir):
    clean = inputs.fact_input(spark, sf_dir)
    survivors = orders.surviving_orders(clean, (0, 100_000))
    return orders.payment_totals(orders.rows_of(clean["payments"], survivors))


def _plain_orders(spark, sf_dir):
    return inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("order_total"),
    )


@query
def customer_order_windows(spark, sf_dir):
    return running.order_windows(_plain_orders(spark, sf_dir))


@query
def customer_windows_in_batches(spark, sf_dir):
    """Two batches; the second goes on for most customers and brings early orders of the others."""
    rows, folder = _plain_orders(spark, sf_dir), _folder(spark, "windows")
    first = (F.year("order_date") < 1997) == (F.col("customer_id") % 3 != 0)
    for batch in (rows.where(first), rows.where(~first)):
        extend_windows(batch, folder, bucket_count=4)
    return buckets.read_table(spark, f"{folder}/rows")


# --- staging and scalar rules ---------------------------------------------------


@query
def stage_orders(spark, sf_dir):
    return stage_table(inputs.raw_orders(spark, sf_dir))


@query
def stage_customers(spark, sf_dir):
    return stage_table(inputs.raw_customers(spark, sf_dir))


@query
def stage_keys(spark, sf_dir):
    raw = inputs.raw_orders(spark, sf_dir)
    return raw.select(
        "OrderID",
        normalize_key(F.col("CustomerID")).alias("staged_key"),
        norm_id(F.col("CustomerID")).alias("weak_key"),
    )


@query
def parse_dates(spark, sf_dir):
    raw, text = inputs.raw_orders(spark, sf_dir), F.col("OrderDate")
    return raw.select(
        "OrderID",
        parse_date_strict(text).alias("strict_date"),
        parse_date_us(text).alias("us_date"),
    )


@query
def parse_money_(spark, sf_dir):
    raw, text = inputs.raw_orders(spark, sf_dir), F.col("TotalPrice")
    return raw.select(
        "OrderID",
        parse_number_strict(text).alias("plain_number"),
        parse_money(text).alias("amount"),
    )


@query
def cell_labels(spark, sf_dir):
    """Segments with blanks, and none at all for customers of nation 0."""
    raw = inputs.raw_customers(spark, sf_dir)
    text = F.when(F.col("NationID") != "0.0", F.col("MarketSegment"))
    return raw.select(
        "CustomerID",
        value_label(text).alias("split_label"),
        merged_label(text).alias("merged_label"),
    )


@query
def sql_functions(spark, sf_dir):
    """The rules called from SQL over registered views."""
    register_functions(spark)
    register_views({"orders": snake_names(inputs.raw_orders(spark, sf_dir))}, "raw")
    return spark.sql(
        "select order_id, norm_id(customer_id) as customer_id,"
        " try_parse_date(order_date) as order_date,"
        " try_parse_numeric(total_price) as total_price from raw_orders"
    )


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def csv_reload(spark, sf_dir):
    """Orders and customers written as CSV folders, found again, read and staged."""
    folder = _folder(spark, "csv")
    for name, build in {"Customers": inputs.raw_customers, "Orders": inputs.raw_orders}.items():
        write_csv(build(spark, sf_dir), f"{folder}/{name}")
    staged = stage_layer(load_layer(spark, folder)[0])
    customers = staged["customers"].withColumnRenamed("customer_name", "c_name")
    return staged["orders"].join(
        customers.select("customer_id", "c_name", "market_segment"), "customer_id"
    )


def _awkward_text(spark, sf_dir):
    """Padded keys, blanks and NULL, quotes, tabs and line breaks."""
    customers = inputs.raw_customers(spark, sf_dir).select(
        F.lit("customers").alias("part"),
        F.col("CustomerID").alias("id"),
        F.col("CustomerName").alias("first"),
        F.when(F.col("NationID") != "0.0", F.col("MarketSegment")).alias("second"),
    )
    documents = inputs.table(spark, sf_dir, "documents").select(
        F.lit("documents"), F.col("doc_id").cast("string"), F.concat(F.lit("\t"), "text"), "lang"
    )
    events = inputs.raw_events(spark, sf_dir).select(F.lit("events"), "EventID", "Props", "EventType")
    return customers.union(documents).union(events)


@query
def csv_reload_raw(spark, sf_dir):
    """The text that comes back, as it is, NULL and empty told apart."""
    folder = _folder(spark, "raw")
    write_csv(_awkward_text(spark, sf_dir), f"{folder}/Text", exact=True)
    return load_layer(spark, folder, exact=True)[0]["text"]


@query
def csv_reload_utf16(spark, sf_dir):
    """Customers in UTF-16 beside others in UTF-8, one table."""
    folder, customers = _folder(spark, "wide"), inputs.raw_customers(spark, sf_dir)
    machines = F.coalesce(F.col("MarketSegment") == "MACHINERY", F.lit(False))
    write_csv(customers.where(~machines), f"{folder}/Customers/plain")
    wide = customers.where(machines).write.option("header", True).option("encoding", "UTF-16")
    wide.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(
        f"{folder}/Customers/wide"
    )
    return load_layer(spark, folder)[0]["customers"]


@query
def csv_line_breaks_utf16(spark, sf_dir):
    """The same text in UTF-16, with its line breaks, split over tasks."""
    folder = _folder(spark, "wide-raw")
    writer = _awkward_text(spark, sf_dir).write.option("header", True).option("encoding", "UTF-16")
    writer = writer.option("escape", '"').option("nullValue", NULL_MARK)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/Text")
    return load_layer(spark, folder, exact=True)[0]["text"]


@query
def csv_nested_folder(spark, sf_dir):
    """A table over several depths and two orders of columns, with another file between."""
    folder, parts = _folder(spark, "nested"), inputs.raw_parts(spark, sf_dir)
    economy = F.col("Type") == "ECONOMY"
    write_csv(parts.where(economy), f"{folder}/Parts/deep/er")
    write_csv(parts.where(~economy).select(*reversed(parts.columns)), f"{folder}/Parts/other")
    parts.select("PartName").write.text(f"{folder}/Parts/notes")
    return load_layer(spark, folder)[0]["parts"]


@query
def dictionary_files(spark, sf_dir):
    """Value dictionaries written as files and read again."""
    folder = _folder(spark, "dictionaries")
    write_dictionaries(_dictionary(spark, sf_dir), folder)
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(folder)
        .withColumn("cnt", F.col("cnt").cast("long"))
    )


@query
def fact_from_clean_csv(spark, sf_dir):
    """The order fact over the cleaned layer written as CSV and read with its types."""
    folder = _folder(spark, "clean")
    for name, df in inputs.fact_input(spark, sf_dir).items():
        write_csv(df, f"{folder}/{name}")
    fact = orders.order_fact(load_clean(spark, folder, inputs.FACT_POLICY))
    kinds = {"order_id": "long", "customer_id": "long", "price_category": "int"}
    return fact.withColumns({c: F.col(c).cast(t) for c, t in kinds.items()})


@query
def csv_append_and_replace(spark, sf_dir):
    """Regions written, written again and appended once more."""
    folder, regions = _folder(spark, "modes"), inputs.raw_regions(spark, sf_dir)
    for mode in ("fail", "replace", "append"):
        write_csv(regions, f"{folder}/Regions", mode)
    return load_layer(spark, folder, only=["regions"])[0]["regions"]


@query
def sorted_export(spark, sf_dir):
    """Order lines as sorted files: each line's place in the concatenated files."""
    lines = inputs.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    folder = _folder(spark, "sorted")
    manifest = write_sorted(lines, folder, ["l_returnflag", F.col("l_orderkey").desc(), "l_linenumber"], rows_per_file=20_000)
    before, files = 0, []
    for f in manifest:
        files.append((f["file"], before))
        before += f["rows"]
    start = spark.createDataFrame(files, "file string, before long")
    rows = spark.read.option("header", True).schema("l_orderkey long, l_linenumber int, l_returnflag string").csv(folder)
    rows = rows.select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("at")) + F.col("before")
    return rows.join(F.broadcast(start), "file").select("l_orderkey", "l_linenumber", "l_returnflag", place.cast("long").alias("place"))


@query
def report_files(spark, sf_dir):
    """The scored scorecard as a report file, and its scores from the file's text again."""
    folder = _folder(spark, "report")
    card = export_scorecard(scorecard(_staged(spark, sf_dir), inputs.CHECKS))
    write_report(card, f"{folder}/Card", ["table_schema", "table_name"])
    return score(load_layer(spark, folder)[0]["card"]).select("table_name", "dq_score_0_100")


# --- scorecard ------------------------------------------------------------------


@query
def null_profile(spark, sf_dir):
    return checks.completeness(_staged(spark, sf_dir))


@query
def pk_profile(spark, sf_dir):
    return checks.key_health(_staged(spark, sf_dir), inputs.CHECKS.primary_keys)


@query
def date_range(spark, sf_dir):
    return checks.date_range(_staged(spark, sf_dir), inputs.CHECKS.dates)


@query
def date_range_two_columns(spark, sf_dir):
    shipments = {"orders": stage_table(inputs.raw_shipments(spark, sf_dir))}
    return checks.date_range(shipments, {"orders": ["order_date", "ship_date"]})


@query
def date_range_us_rule(spark, sf_dir):
    shipments = {"orders": stage_table(inputs.raw_shipments(spark, sf_dir))}
    return checks.date_range(shipments, {"orders": ["order_date", "ship_date"]}, rule="us")


@query
def negative_flags(spark, sf_dir):
    return checks.negative_rows(_staged(spark, sf_dir), inputs.CHECKS.numbers)


@query
def negative_flags_without_separators(spark, sf_dir):
    staged = _staged(spark, sf_dir)
    return checks.negative_rows(staged, inputs.CHECKS.numbers, strip_thousands=True)


@query
def fk_report(spark, sf_dir):
    return relations.fk_report(_staged(spark, sf_dir), inputs.CHECKS.relations)


@query
def fk_report_unstaged(spark, sf_dir):
    """Keys as exported: normalising them explains part of the orphans."""
    raw = {t: snake_names(df) for t, df in inputs.raw_layer(spark, sf_dir).items()}
    return relations.fk_report(raw, inputs.CHECKS.relations, schema="raw")


@query
def fk_detail_worst_first(spark, sf_dir):
    report = relations.fk_report(_staged(spark, sf_dir), inputs.CHECKS.relations)
    return export_fk_detail(report, by="orphans").drop("checked_at")


@query
def fk_rollup(spark, sf_dir):
    return relations.fk_rollup(fk_report(spark, sf_dir))


@query
def fk_exceptions(spark, sf_dir):
    """Child rows without a parent, one by one."""
    return exceptions.fk_exceptions(_staged(spark, sf_dir), inputs.CHECKS.relations, inputs.CHECKS.primary_keys)


@query
def recon_buckets(spark, sf_dir):
    return relations.recon_buckets(fk_report(spark, sf_dir))


@query
def scorecard_(spark, sf_dir):
    return export_scorecard(scorecard(_staged(spark, sf_dir), inputs.CHECKS)).drop("updated_at")


@query
def scorecard_of_loads(spark, sf_dir):
    """The scorecard of two loads, each scanned once."""
    folder = _folder(spark, "loads")
    write_layer(_staged(spark, sf_dir), f"{folder}/staged")
    staged = read_layer(spark, f"{folder}/staged", list(_staged(spark, sf_dir)))
    for i in range(2):
        load = {t: df.where(F.pmod(F.xxhash64(*df.columns), F.lit(2)) == i) for t, df in staged.items()}
        add_load(spark, folder, f"load {i}", load, inputs.CHECKS)
    return export_scorecard(merged_scorecard(spark, folder, inputs.CHECKS)).drop("updated_at")


@query
def scorecard_scored(spark, sf_dir):
    return score(export_scorecard(scorecard(_staged(spark, sf_dir), inputs.CHECKS)))


@query
def scorecard_merge(spark, sf_dir):
    staged = _staged(spark, sf_dir)
    rows = checks.completeness(staged).select("table_schema", "table_name", "row_count")
    health = checks.key_health(staged, inputs.CHECKS.primary_keys)
    return merge_metrics(rows, health, checks.date_range(staged, inputs.CHECKS.dates))


# --- column profiles ------------------------------------------------------------


def _dictionary_tables(spark, sf_dir):
    """Tables whose values are counted, with the columns."""
    columns = {
        "customers": (snake_names(inputs.raw_customers(spark, sf_dir)), ["market_segment", "nation_id"]),
        "events": (snake_names(inputs.raw_events(spark, sf_dir)), ["event_type", "user_id"]),
        "parts": (snake_names(inputs.raw_parts(spark, sf_dir)), ["brand", "type", "size"]),
        "documents": (inputs.table(spark, sf_dir, "documents"), ["lang", "source", "text"]),
    }
    return {t: (df.select(*c), c) for t, (df, c) in columns.items()}


def _dictionary(spark, sf_dir, labels="split"):
    tables = _dictionary_tables(spark, sf_dir)
    return union_all(profiling.value_dictionary(df, c, t, "raw", labels) for t, (df, c) in tables.items())


@query
def value_dictionary(spark, sf_dir):
    return _dictionary(spark, sf_dir)


@query
def value_list_merged(spark, sf_dir):
    return _dictionary(spark, sf_dir, "merged")


@query
def dictionary_index(spark, sf_dir):
    return profiling.dictionary_index(_dictionary(spark, sf_dir))


@query
def top_values(spark, sf_dir):
    return profiling.top_values(_dictionary(spark, sf_dir), 3)


@query
def top_values_long(spark, sf_dir):
    """More values than Spark's own per-task limit handles."""
    return profiling.top_values(_dictionary(spark, sf_dir), 1200)


@query
def top_values_by_sketch(spark, sf_dir):
    """The same three values without a dictionary of all."""
    frames = []
    for table, (df, columns) in _dictionary_tables(spark, sf_dir).items():
        frames.append(heavy.top_values_of(df, columns, table, 3, "raw", tracked=256, buckets=1024))
    return union_all(frames)


@query
def layer_distincts_approx(spark, sf_dir):
    """Whether distinct counts merged out of two loads are within the bound."""
    tables = {t: df for t, (df, _) in _dictionary_tables(spark, sf_dir).items()}
    half = F.pmod(F.xxhash64(F.struct("*")), F.lit(2))
    loads = [heavy.distinct_states({t: df.where(half == i) for t, df in tables.items()}, "raw") for i in range(2)]
    found = heavy.estimated_distincts(loads[0].unionByName(loads[1]))
    exact = profiling.layer_distincts(tables, {}, "raw").select(
        *profiling.COLUMN_KEY, F.col("distinct_including_null").alias("exact"), F.col("null_rows_in_column").alias("missing")
    )
    error = F.abs(F.col("distinct_including_null") - F.col("exact"))
    return found.join(exact, profiling.COLUMN_KEY).select(
        "table_name",
        "column_name",
        "exact",
        "null_rows_in_column",
        (error <= heavy.error_bound() * F.col("exact")).alias("within_bound"),
    )


@query
def distinct_with_null(spark, sf_dir):
    return profiling.distinct_with_null(_dictionary(spark, sf_dir, "merged"))


@query
def layer_distincts(spark, sf_dir):
    keys = {
        "customers": {"customer_id": "PK", "nation_id": "FK"},
        "orders": {"order_id": "PK", "customer_id": "FK"},
        "suppliers": {"supplier_id": "PK", "nation_id": "FK"},
    }
    staged = _staged(spark, sf_dir)
    return profiling.layer_distincts({t: staged[t] for t in keys}, keys)


def _numeric_tables(spark, sf_dir):
    lines = inputs.table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"
    )
    parts = inputs.table(spark, sf_dir, "part").select("p_size", "p_retailprice")
    return lines, parts


def _described(spark, sf_dir, approx=False):
    lines, parts = _numeric_tables(spark, sf_dir)
    return profiling.describe_tables({"lineitem": lines, "part": parts}, approx=approx)


@query
def describe_numeric(spark, sf_dir):
    return _rounded(_described(spark, sf_dir), "mean", "std", "min", "p25", "p50", "p75", "max")


@query
def describe_layout(spark, sf_dir):
    parts = inputs.table(spark, sf_dir, "part").select("p_size", "p_retailprice")
    laid = profiling.describe_layout(profiling.describe_numeric(parts), parts.columns)
    return _rounded(laid, "p_size", "p_retailprice")


@query
def describe_approx(spark, sf_dir):
    """Whether each sketched quartile's rank is within rows / accuracy of the exact one."""
    accuracy, named = 10_000, dict(zip(("lineitem", "part"), _numeric_tables(spark, sf_dir), strict=True))
    found = [r.asDict() for r in _described(spark, sf_dir, approx=True).collect()]
    frames = []
    for name, df in named.items():
        checks = []
        for r in (r for r in found if r["table_name"] == name):
            cell, n = F.col(r["field"]).cast("double"), r["count"]
            for quartile, p in profiling.QUARTILES.items():
                value, slack = r[quartile], n / accuracy + 1
                near = (F.count_if(cell < value) <= p * n + slack) & (F.count_if(cell <= value) >= p * n - slack)
                checks.append(
                    F.struct(
                        F.lit(name).alias("table_name"),
                        F.lit(r["field"]).alias("field"),
                        F.lit(quartile).alias("quartile"),
                        near.alias("near"),
                    )
                )
        frames.append(df.agg(F.array(*checks).alias("c")).select(F.inline("c")))
    return union_all(frames)


@query
def tail_profile(spark, sf_dir):
    profile = profiling.tail_profile(_described(spark, sf_dir), threshold=2.0)
    return _rounded(profile, "median", "max", "max_to_median")


@query
def numeric_ratios(spark, sf_dir):
    ratios = profiling.numeric_ratios(snake_names(inputs.raw_customers(spark, sf_dir)))
    return _rounded(ratios, "ratio")


@query
def coerce_numeric(spark, sf_dir):
    text = snake_names(inputs.raw_customers(spark, sf_dir)).drop("nation_id")
    coerced = profiling.coerce_numeric(text)
    return _rounded(coerced, "account_balance")


@query
def describe_coerced(spark, sf_dir):
    described = profiling.describe_table(snake_names(inputs.raw_order_details(spark, sf_dir)))
    return _rounded(described, "mean", "std", "min", "p25", "p50", "p75", "max")


@query
def describe_categorical(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents").select("text", "lang", "source")
    return profiling.describe_categorical(documents)


# --- cleaning -------------------------------------------------------------------


@query
def date_format_election(spark, sf_dir):
    tables = {t: snake_names(df) for t, df in inputs.cleaning_input(spark, sf_dir).items()}
    policy = inputs.CLEANING
    return cleaning.date_format_counts(
        tables["orders"], ["order_date", "ship_date"], policy.date_formats
    )


@query
def free_form_dates(spark, sf_dir):
    """A column with dates in six forms, and some that are none."""
    forms = ["d MMM yyyy", "MMMM d, yyyy", "yyyy-MM-dd'T'HH:mm:ss", "dd.MM.yyyy", "EEE, dd MMM yy", "yyyyMMdd"]
    day, form = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % len(forms)
    text = F.coalesce(*[F.when(form == i, F.date_format(day, f)) for i, f in enumerate(forms)])
    orders = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.when(F.col("o_custkey") % 50 == 0, "soon").otherwise(text).alias("order_date")
    )
    policy = CleaningPolicy(infer_dates=True, date_order={})
    return clean_layer({"orders": orders}, policy)["orders"]


@query
def cleaned_orders(spark, sf_dir):
    return clean_layer(inputs.cleaning_input(spark, sf_dir), inputs.CLEANING)["orders"]


@query
def cleaned_products(spark, sf_dir):
    return clean_layer(inputs.cleaning_input(spark, sf_dir), inputs.CLEANING)["products"]


@query
def cleaning_report_(spark, sf_dir):
    return cleaning_report(
        inputs.cleaning_input(spark, sf_dir), inputs.CLEANING, {"orders": "utf-8"}
    )


@query
def impute_unknown(spark, sf_dir):
    return cleaning.impute(snake_names(inputs.raw_products(spark, sf_dir)), {"color": "unknown"})


@query
def lead_time_flags(spark, sf_dir):
    dates = inputs.fact_input(spark, sf_dir)["orders"].select("order_id", "order_date", "ship_date")
    return cleaning.add_date_order_flags(dates, "order_date", "ship_date")


@query
def temporal_anomalies(spark, sf_dir):
    shipments = snake_names(inputs.raw_shipments(spark, sf_dir))
    return cleaning.date_order_violations(shipments, "order_date", "ship_date")


@query
def us_date_range(spark, sf_dir):
    return cleaning.us_date_range(snake_names(inputs.raw_shipments(spark, sf_dir)), "order_date")


@query
def anomaly_sample(spark, sf_dir):
    cleaned = clean_layer(inputs.cleaning_input(spark, sf_dir), inputs.CLEANING)["orders"]
    return cleaning.anomaly_sample(cleaned)


@query
def date_window_check(spark, sf_dir):
    lines = inputs.table(spark, sf_dir, "lineitem")
    return cleaning.date_window(lines, "l_shipdate", "1996-01-01", "2000-12-31")


@query
def days_to_ship(spark, sf_dir):
    """Earliest and latest lead time over all order lines."""
    lines, heads = (inputs.table(spark, sf_dir, t) for t in ("lineitem", "orders"))
    joined = lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
    lead = lead_days(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date"))
    return joined.groupBy("l_linestatus").agg(
        F.min(lead).alias("min_lead"),
        F.max(lead).alias("max_lead"),
        F.count_if(lead < 0).alias("negative_leads"),
    )


# --- table maintenance ----------------------------------------------------------

KEYS = ["table_schema", "table_name"]


@query
def upsert_scorecard(spark, sf_dir):
    """Recomputed metrics replace their rows and keep those they do not cover."""
    raw, staged = inputs.raw_layer(spark, sf_dir), _staged(spark, sf_dir)
    before = checks.completeness({t: snake_names(df) for t, df in raw.items()})
    again = checks.completeness({t: staged[t] for t in ("customers", "orders", "parts")})
    return maintenance.upsert(before, again, KEYS)


@query
def insert_missing_tables(spark, sf_dir):
    staged = _staged(spark, sf_dir)
    listed = checks.completeness({t: staged[t] for t in ("customers", "orders")})
    return maintenance.insert_if_absent(listed, checks.completeness(staged).select(*KEYS), KEYS)


@query
def upsert_customers(spark, sf_dir):
    """Customers with a negative balance arrive again with it set to zero."""
    customers = inputs.table(spark, sf_dir, "customer")
    repaired = customers.where("c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0))
    return maintenance.upsert(customers, repaired, ["c_custkey"])


@query
def upsert_customer_buckets(spark, sf_dir):
    """The same upsert into a stored table, and new customers only added."""
    customers = inputs.table(spark, sf_dir, "customer")
    folder = _folder(spark, "buckets")
    buckets.create_table(customers.where("c_nationkey < 20"), folder, ["c_custkey"], buckets=16)
    buckets.upsert_table(customers.withColumn("c_acctbal", F.lit(-1.0)), folder, replace_rows=False)
    repaired = customers.withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0.0)))
    buckets.upsert_table(repaired.where("c_acctbal = 0 or c_nationkey >= 20"), folder)
    return buckets.read_table(spark, folder)


@query
def load_summary(spark, sf_dir):
    return maintenance.load_summary(inputs.raw_layer(spark, sf_dir), "raw")
