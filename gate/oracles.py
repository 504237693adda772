"""SQL twin of each query, for an independent engine."""

from __future__ import annotations

from assayer.config import key_list
from gate.inputs import CHECKS
from gate.sql_layers import (
    CLEAN_ORDERS,
    COLUMNS,
    FACT_LAYER,
    PRODUCTS,
    RAW,
    SHIPMENTS,
    fact_sql,
    float_text,
    money_text,
    plain_number,
    staged,
    staged_key,
    strict_date,
    us_date,
    weak_key,
    with_layer,
)

TABLES = list(RAW)


def _union(parts: list[str]) -> str:
    return " union all ".join(parts)


def _name(table: str, schema: str = "stg") -> str:
    return f"'{schema}' as table_schema, '{table}' as table_name"


def _pct(part: str, whole: str, digits: int = 4) -> str:
    """Rounded on the exact fraction: add half a unit in integers, then cut."""
    unit = 10**digits
    exact = f"({part})::hugeint * {200 * unit} + ({whole})"
    return (
        f"case when ({whole}) = 0 then null else"
        f" ((({exact}) // (2 * ({whole})::hugeint))::decimal(18,0) / {unit})::decimal(9,4) end"
    )


# --- completeness, keys, dates, signs -------------------------------------------


def _completeness(t: str, kind: str = "stg", schema: str = "stg") -> str:
    nulls = " + ".join(f'count(*) filter ("{c}" is null)' for c in COLUMNS[t])
    n = len(COLUMNS[t])
    return f"""
      select {_name(t, schema)}, row_count, null_cells::bigint as null_cells, {n} as col_count,
             row_count * {n} as total_cells,
             {_pct("null_cells", f"row_count * {n}")} as overall_null_pct
      from (select count(*) as row_count, {nulls} as null_cells from {kind}_{t})"""


def _key(t: str) -> str:
    key = CHECKS.primary_keys[t]
    columns = [key] if isinstance(key, str) else list(key)
    missing = " or ".join(f"{c} is null" for c in columns)
    return f"""
      select {_name(t)}, '{",".join(columns)}' as suspected_pk,
             {_pct("missing", "total")} as pk_null_pct, (present - kinds)::bigint as pk_duplicate_rows
      from (select count(*) as total, count(*) filter ({missing}) as missing,
                   count(*) filter (not ({missing})) as present,
                   count(distinct ({", ".join(columns)})) filter (not ({missing})) as kinds
            from stg_{t})"""


def _dates(t: str) -> str:
    (column,) = CHECKS.dates[t]
    parsed = strict_date(column)
    return f"select {_name(t)}, min({parsed}) as date_min, max({parsed}) as date_max from stg_{t}"


def _negatives(t: str, clean: bool = False) -> str:
    cells = [f"replace(\"{c}\", ',', '')" if clean else f'"{c}"' for c in CHECKS.numbers[t]]
    negative = " or ".join(f"coalesce({plain_number(c)} < 0, false)" for c in cells)
    return f"select {_name(t)}, count(*) filter ({negative}) as neg_value_flags from stg_{t}"


# --- relations ------------------------------------------------------------------


def _relation(r, kind: str) -> str:
    weak_fk, weak_pk = weak_key("fk"), weak_key(r.pk)
    return f"""
      select '{kind}' as child_schema, '{r.child}' as child_table, '{r.fk}' as child_fk_col,
             '{kind}' as parent_schema, '{r.parent}' as parent_table, '{r.pk}' as parent_pk_col,
             count(fk) as fk_non_null_rows,
             count(*) filter (fk is null) as null_fk_rows,
             count(*) filter (fk is not null and not raw_hit) as orphan_rows_raw,
             count(*) filter (weak is not null and not weak_hit) as orphan_rows_norm,
             count(*) filter (fk is not null and not raw_hit and weak_hit)
               as fixable_by_normalize_rows,
             count(*) filter (weak is not null and not weak_hit) as orphan_rows
      from (select fk, weak, a.k is not null as raw_hit, b.k is not null as weak_hit
            from (select {r.fk} as fk, {weak_fk.replace("fk", r.fk)} as weak from {kind}_{r.child})
            left join (select distinct {r.pk} as k from {kind}_{r.parent}) a on a.k = fk
            left join (select distinct {weak_pk} as k from {kind}_{r.parent}) b on b.k = weak)"""


def _relations(kind: str = "stg") -> str:
    return _union([_relation(r, kind) for r in CHECKS.relations])


def _exceptions(r) -> str:
    parts = " || '|' || ".join(f"coalesce({c}, '')" for c in key_list(CHECKS.primary_keys[r.child]))
    return f"""
        select '{r.child}.{r.fk} -> {r.parent}.{r.pk}' as relationship, {parts} as child_key,
               {r.fk} as fk_value, case when {r.fk} is null then 'FK NULL' else 'Orphan' end as fk_status,
               coalesce({weak_key(r.fk)} in
                   (select {weak_key(r.pk)} from stg_{r.parent} where {weak_key(r.pk)} is not null), false) as fixable
        from stg_{r.child}
        where {r.fk} is null or {r.fk} not in (select {r.pk} from stg_{r.parent} where {r.pk} is not null)"""


FK = f"{with_layer()}, fk as ({_relations()})"
ROLLUP = """select child_schema as table_schema, child_table as table_name,
       sum(orphan_rows_norm)::bigint as fk_orphan_rows,
       sum(fixable_by_normalize_rows)::bigint as fk_fixable_by_normalize_rows
from fk group by 1, 2"""

SCORECARD = f"""{FK}, comp as ({_union([_completeness(t) for t in TABLES])}),
keys as ({_union([_key(t) for t in TABLES])}),
ranges as ({_union([_dates(t) for t in CHECKS.dates])}),
signs as ({_union([_negatives(t) for t in CHECKS.numbers])}),
roll as ({ROLLUP}),
card as (
  select table_schema, table_name, row_count, col_count, null_cells, total_cells, overall_null_pct,
         suspected_pk, pk_null_pct, pk_duplicate_rows, date_min, date_max, neg_value_flags,
         fk_orphan_rows
  from comp left join keys using (table_schema, table_name)
            left join ranges using (table_schema, table_name)
            left join signs using (table_schema, table_name)
            left join roll using (table_schema, table_name))
"""

SCORE = """select *, round_even(greatest(0.0, least(100.0,
    100.0 - least(30.0, coalesce(overall_null_pct, 0)::double * 0.8)
          - least(30.0, coalesce(pk_null_pct, 0)::double * 2.0)
          - case when pk_duplicate_rows > 0
                 then least(30.0, 10.0 + log10(pk_duplicate_rows + 1.0) * 10.0) else 0 end
          - case when neg_value_flags > 0 then least(20.0, neg_value_flags * 5.0) else 0 end
          - case when fk_orphan_rows > 0 and row_count > 0
                 then least(40.0, fk_orphan_rows::double / row_count * 40.0) else 0 end
          - case when (date_min is null) <> (date_max is null) then 5.0 else 0 end)), 0)::integer
    as dq_score_0_100
from card"""


# --- dictionaries ---------------------------------------------------------------

DICTIONARY_COLUMNS = {
    "customers": ["market_segment", "nation_id"],
    "events": ["event_type", "user_id"],
    "parts": ["brand", "type", "size"],
    "documents": ["lang", "source", "text"],
}


def _dictionary(merged: bool = False) -> str:
    blank = "[NULL]" if merged else "[BLANK]"
    parts = []
    for t, columns in DICTIONARY_COLUMNS.items():
        source = t if t == "documents" else f"({RAW[t]})"
        for c in columns:
            label = f"""case when "{c}" is null then '[NULL]' when trim("{c}") = '' then '{blank}'
                        else trim("{c}") end"""
            parts.append(
                f"select {_name(t, 'raw')}, '{c}' as column_name, {label} as col_value,"
                f" count(*) as cnt from {source} group by 4"
            )
    return _union(parts)


def _ranked(n: int) -> str:
    return f"""select *, (row_number() over (partition by table_name, column_name
                                             order by cnt desc, col_value)) as rank
               from ({_dictionary()}) qualify rank <= {n}"""


def _distincts(t: str, roles: dict[str, str], source: str, schema: str) -> str:
    return _union(
        [
            f"""select {_name(t, schema)}, '{c}' as column_name,
                       count(distinct coalesce("{c}", '[NULL]')) as distinct_including_null,
                       count(*) filter ("{c}" is null) as null_rows_in_column,
                       {f"'{roles[c]}'" if c in roles else "null::varchar"} as key_role
                from ({source})"""
            for c in COLUMNS[t]
        ]
    )


# --- descriptions ---------------------------------------------------------------


def _describe(source: str, column: str, name: str | None = None) -> str:
    v = f"({column})::double"
    r = "round({}, 6)".format
    return f"""
      select '{name or column}' as field, count({v}) as count, {r(f"avg({v})")} as mean,
             {r(f"stddev_samp({v})")} as std, {r(f"min({v})")} as "min",
             {r(f"quantile_cont({v}, 0.25)")} as p25, {r(f"quantile_cont({v}, 0.5)")} as p50,
             {r(f"quantile_cont({v}, 0.75)")} as p75, {r(f"max({v})")} as "max"
      from {source}"""


NUMERIC = {
    "lineitem": "l_quantity l_extendedprice l_discount l_tax l_linenumber".split(),
    "part": "p_size p_retailprice".split(),
}
DESCRIBE = _union(
    [
        f"select '{t}' as table_name, * from ({_describe(t, c)})"
        for t, columns in NUMERIC.items()
        for c in columns
    ]
)

LAYOUT_ROWS = {
    "count": "count({})::double",
    "mean": "round(avg({}), 6)",
    "std": "round(stddev_samp({}), 6)",
    "min": "min({})",
    "25%": "quantile_cont({}, 0.25)",
    "50%": "quantile_cont({}, 0.5)",
    "75%": "quantile_cont({}, 0.75)",
    "max": "max({})",
}


def _layout_cell(expression: str, column: str) -> str:
    return f"round(({expression.format(column + '::double')})::double, 6) as {column}"


def _categorical(c: str) -> str:
    return f"""
      select '{c}' as field, sum(n)::bigint as count, count(*) as "unique",
             arg_min(v, (-n, v)) as top, max(n) as freq
      from (select {c} as v, count(*) as n from documents where {c} is not null group by 1)"""


def _ratio(c: str) -> str:
    number = float_text(c)
    return f"""select '{c}' as column_name, count({c}) as present, count({number}) as "numeric",
                      round(count({number}) / nullif(count({c}), 0), 6) as ratio
               from ({RAW["customers"]})"""


# --- cleaning -------------------------------------------------------------------

# Spark pattern -> strptime pattern.
FORMATS = {
    "M-d-yyyy": "%m-%d-%Y",
    "yyyy-M-d": "%Y-%m-%d",
    "M/d/yyyy": "%m/%d/%Y",
    "yyyy/M/d": "%Y/%m/%d",
    "d-M-yyyy": "%d-%m-%Y",
    "d/M/yyyy": "%d/%m/%Y",
}


def _election(c: str) -> str:
    return _union(
        [
            f"""select '{c}' as column_name, {i} as preference, '{f}' as format,
                       count({c}) as present, count(try_strptime({c}, '{p}')) as parsed
                from ({SHIPMENTS})"""
            for i, (f, p) in enumerate(FORMATS.items())
        ]
    )


REPORT = f"""
  select 'orders' as "table", count(*) as "rows", 7 as cols, 'utf-8' as source_encoding,
         2 as id_cols_count, 'order_id,customer_id' as id_cols, 2 as date_cols_count,
         'order_date,ship_date' as date_cols,
         (count(order_date) - count(try_strptime(order_date, '%m/%d/%Y'))
          + count(ship_date) - count(try_strptime(ship_date, '%m/%d/%Y')))::bigint
           as invalid_date_total,
         0::bigint as imputed_string_total, '{{}}' as imputed_string_counts,
         count(*) filter (try_strptime(order_date, '%m/%d/%Y') > try_strptime(ship_date, '%m/%d/%Y'))
           as orderdate_gt_shipdate_cnt
  from ({SHIPMENTS})
  union all
  select 'products', count(*), 4, '', 1, 'product_id', 0, '', 0, count(*) filter (color is null),
         '{{''color'': ' || count(*) filter (color is null) || '}}', 0
  from ({PRODUCTS})"""

ANY_LEAD = "not gone and ship_lead_days between 0 and 100000 and freight_charge >= 0"
SURVIVING = f"{FACT_LAYER} select {{}} from clean_orders o join clean_customers c using (customer_id)"

CELL_LABELS = f"""
  select customer_id as "CustomerID",
         case when seg is null then '[NULL]' when seg = '' then '[BLANK]' else seg end as split_label,
         case when coalesce(seg, '') = '' then '[NULL]' else seg end as merged_label
  from (select *, case when nation_id <> '0.0' then market_segment end as seg
        from ({RAW["customers"]}))"""

AWKWARD_TEXT = f"""
  select 'customers' as part, customer_id as id, customer_name as first,
         case when nation_id <> '0.0' then market_segment end as second from ({RAW["customers"]})
  union all select 'documents', doc_id::varchar, chr(9) || text, lang from documents
  union all select 'events', event_id, props, event_type from ({RAW["events"]})"""


def _exported(table: str, *renamed: str) -> str:
    """A raw table under its export names, with empty text as NULL."""
    names = dict(x.split("=") for x in renamed)
    cells = ", ".join(f"nullif({c}, '') as \"{n}\"" for c, n in names.items())
    return f"select {cells} from ({RAW[table]})"


CUSTOMERS_FILE = _exported(
    "customers",
    "customer_id=CustomerID",
    "customer_name=CustomerName",
    "nation_id=NationID",
    "account_balance=AccountBalance",
    "market_segment=MarketSegment",
)
PARTS_FILE = _exported(
    "parts",
    "part_id=PartID",
    "part_name=PartName",
    "brand=Brand",
    '"type"=Type',
    "size=Size",
    "retail_price=RetailPrice",
)
REGIONS_FILE = _exported("regions", "region_id=RegionID", "region_name=RegionName")


def _date_pair(rule) -> str:
    both = f"{rule('order_date')}, {rule('ship_date')}"
    return f"""select {_name("orders")}, min(least({both})) as date_min,
                      max(greatest({both})) as date_max from ({SHIPMENTS})"""


MISSING = f"""select {_name("{t}")}, null::bigint as row_count, null::bigint as null_cells,
  null::integer as col_count, null::bigint as total_cells, null::decimal(9,4) as overall_null_pct"""

CUSTOMER_WINDOWS = """
        select o_orderkey as order_id, o_custkey as customer_id, o_orderdate::date as order_date,
               o_totalprice::decimal(18,2) as order_total, row_number() over w as order_seq,
               (o_orderdate::date - lag(o_orderdate::date) over w)::integer as days_since_prev_order,
               (sum(o_totalprice::decimal(18,2)) over (w rows unbounded preceding))::decimal(18,2)
                 as customer_running_spend
        from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)"""

ORACLES: dict[str, str] = {
    "order_fact": fact_sql(0, 30),
    "order_fact_any_lead": fact_sql(0, 100_000),
    "order_fact_heavy_customers": fact_sql(0, 100_000),
    "order_fact_without_returns": fact_sql(0, 100_000, "l_returnflag <> 'R'"),
    "credible_orders": SURVIVING.format(
        "order_id, customer_id, order_date, ship_date, freight_charge, ship_lead_days"
    )
    + f" where {ANY_LEAD}",
    "line_totals": SURVIVING.format("l.*")
    + f" join lines l on l.order_id = o.order_id where {ANY_LEAD}",
    "payment_totals": SURVIVING.format("p.*")
    + f" join pays p on p.order_id = o.order_id where {ANY_LEAD}",
    "customer_windows_in_batches": CUSTOMER_WINDOWS,
    "customer_order_windows": CUSTOMER_WINDOWS,
    "stage_orders": staged("orders"),
    "stage_customers": staged("customers"),
    "stage_keys": f"""select order_id as "OrderID", {staged_key("customer_id")} as staged_key,
        {weak_key("customer_id")} as weak_key from ({RAW["orders"]})""",
    "parse_dates": f"""select order_id as "OrderID", {strict_date("order_date")} as strict_date,
        {us_date("order_date")} as us_date from ({RAW["orders"]})""",
    "parse_money": f"""select order_id as "OrderID", {plain_number("total_price")} as plain_number,
        coalesce({money_text("total_price")}, 0)::decimal(18,2) as amount from ({RAW["orders"]})""",
    "cell_labels": CELL_LABELS,
    "sql_functions": f"""select order_id, {weak_key("customer_id")} as customer_id,
        {strict_date("order_date")} as order_date, {plain_number("total_price")} as total_price
        from ({RAW["orders"]})""",
    "csv_reload": f"""{with_layer(tables=["customers", "orders"])}
        select o.*, customer_name as c_name, market_segment
        from stg_orders o join stg_customers using (customer_id)""",
    "csv_reload_raw": AWKWARD_TEXT,
    "csv_reload_utf16": CUSTOMERS_FILE,
    "csv_line_breaks_utf16": AWKWARD_TEXT,
    "csv_nested_folder": PARTS_FILE,
    "csv_append_and_replace": f"{REGIONS_FILE} union all {REGIONS_FILE}",
    "sorted_export": """select l_orderkey, l_linenumber, l_returnflag,
        row_number() over (order by l_returnflag nulls first, l_orderkey desc, l_linenumber) as place from lineitem""",
    "dictionary_files": _dictionary(),
    "fact_from_clean_csv": fact_sql(0, 30),
    "report_files": f"{SCORECARD} select table_name, dq_score_0_100 from ({SCORE})",
    "null_profile": f"{with_layer()} {_union([_completeness(t) for t in TABLES])}",
    "pk_profile": f"{with_layer()} {_union([_key(t) for t in TABLES])}",
    "date_range": f"{with_layer()} {_union([_dates(t) for t in CHECKS.dates])}",
    "date_range_two_columns": _date_pair(strict_date),
    "date_range_us_rule": _date_pair(us_date),
    "negative_flags": f"{with_layer()} {_union([_negatives(t) for t in CHECKS.numbers])}",
    "negative_flags_without_separators": (
        f"{with_layer()} {_union([_negatives(t, True) for t in CHECKS.numbers])}"
    ),
    "fk_exceptions": f"{with_layer()} {_union([_exceptions(r) for r in CHECKS.relations])}",
    "fk_report": f"{FK} select * from fk",
    "fk_report_unstaged": f"{with_layer('raw')} {_relations('raw')}",
    "fk_detail_worst_first": f"""{FK} select child_schema, child_table, child_fk_col, parent_schema,
        parent_table, parent_pk_col, orphan_rows, fk_non_null_rows as base_rows, null_fk_rows,
        orphan_rows_raw, orphan_rows_norm, fixable_by_normalize_rows from fk
        order by orphan_rows desc, child_table, child_fk_col""",
    "fk_rollup": f"{FK} {ROLLUP}",
    "recon_buckets": f"""{FK}, r as (select *, fk_non_null_rows + null_fk_rows as base_rows from fk)
        select child_table || '.' || child_fk_col || ' -> ' || parent_table || '.' || parent_pk_col
                 as relationship,
               base_rows, null_fk_rows as fk_null_rows, fk_non_null_rows,
               fk_non_null_rows - orphan_rows_raw as matched_rows, orphan_rows_raw as orphan_rows,
               {_pct("null_fk_rows", "base_rows", 2)} as null_pct,
               case when 20 * (null_fk_rows + orphan_rows_raw) > base_rows then 'High'
                    when 100 * (null_fk_rows + orphan_rows_raw) >= base_rows then 'Medium'
                    else 'Low' end as severity
        from r""",
    "scorecard": f"{SCORECARD} select * from card order by table_schema, table_name",
    "scorecard_of_loads": f"{SCORECARD} select * from card",
    "scorecard_scored": f"{SCORECARD} {SCORE}",
    "scorecard_merge": f"""{SCORECARD} select table_schema, table_name, row_count, suspected_pk,
        pk_null_pct, pk_duplicate_rows, date_min, date_max from card""",
    "value_dictionary": _dictionary(),
    "value_list_merged": _dictionary(merged=True),
    "dictionary_index": f"""
        select table_schema, table_name, column_name, sum(cnt)::bigint as total_rows,
               count(*) as distinct_cnt_mapped,
               coalesce(sum(cnt) filter (col_value = '[NULL]'), 0)::bigint as null_cnt,
               coalesce(sum(cnt) filter (col_value = '[BLANK]'), 0)::bigint as blank_cnt,
               arg_min(col_value, (-cnt, col_value)) as top_value, max(cnt) as top_cnt,
               {_pct("max(cnt)", "sum(cnt)", 2)} as top_pct
        from ({_dictionary()}) group by 1, 2, 3""",
    "top_values": _ranked(3),
    "top_values_long": _ranked(1200),
    "top_values_by_sketch": _ranked(3),
    "layer_distincts_approx": f"""
        select table_name, column_name, count(*) as exact,
               coalesce(sum(cnt) filter (col_value = '[NULL]'), 0)::bigint as null_rows_in_column,
               true as within_bound
        from ({_dictionary(merged=True)}) group by 1, 2""",
    "distinct_with_null": f"""
        select table_schema, table_name, column_name, count(*) as distinct_including_null,
               coalesce(sum(cnt) filter (col_value = '[NULL]'), 0)::bigint as null_rows_in_column
        from ({_dictionary(merged=True)}) group by 1, 2, 3""",
    "layer_distincts": _union(
        [
            _distincts("customers", {"customer_id": "PK", "nation_id": "FK"}, staged("customers"), "stg"),
            _distincts("orders", {"order_id": "PK", "customer_id": "FK"}, staged("orders"), "stg"),
            _distincts(
                "suppliers", {"supplier_id": "PK", "nation_id": "FK"}, staged("suppliers"), "stg"
            ),
        ]
    ),
    "describe_numeric": DESCRIBE,
    "describe_layout": _union(
        [
            f"""select '{name}' as statistic, {_layout_cell(e, "p_retailprice")},
                {_layout_cell(e, "p_size")} from part"""
            for name, e in LAYOUT_ROWS.items()
        ]
    ),
    "describe_approx": _union(
        [
            f"select '{t}' as table_name, '{c}' as field, '{q}' as quartile, count(*) >= 0 as near from {t}"
            for t, columns in NUMERIC.items()
            for c in columns
            for q in ("p25", "p50", "p75")
        ]
    ),
    "tail_profile": _union(
        [
            f"""select '{c}' as field, round(median({c}::double), 6) as median,
                round(max({c}::double), 6) as "max",
                round(max({c}::double) / nullif(median({c}::double), 0), 6) as max_to_median,
                max({c}::double) > 2 * median({c}::double) as long_tail from {t}"""
            for t, columns in NUMERIC.items()
            for c in columns
        ]
    ),
    "numeric_ratios": _union([_ratio(c) for c in COLUMNS["customers"]]),
    "coerce_numeric": f"""
        select {float_text("customer_id")} as customer_id, customer_name,
               round({float_text("account_balance")}, 6) as account_balance, market_segment
        from ({RAW["customers"]})""",
    "describe_coerced": _union(
        [
            _describe(f"({RAW['order_details']})", float_text(c), c)
            for c in "order_id line_number quantity extended_price".split()
        ]
    ),
    "describe_categorical": _union([_categorical(c) for c in ("text", "lang", "source")]),
    "date_format_election": _union([_election(c) for c in ("order_date", "ship_date")]),
    "free_form_dates": """select o_orderkey::varchar as order_id,
        case when o_custkey % 50 <> 0 then o_orderdate::date end as order_date from orders""",
    "cleaned_orders": CLEAN_ORDERS,
    "cleaned_products": f"""select {staged_key("product_id")} as product_id, product_name,
        coalesce(color, 'unknown') as color, {money_text("purchase_price")} as purchase_price
        from ({PRODUCTS})""",
    "cleaning_report": f"{REPORT} order by 1",
    "impute_unknown": f"""select product_id, product_name, coalesce(color, 'unknown') as color,
        purchase_price from ({PRODUCTS})""",
    "lead_time_flags": f"""{FACT_LAYER} select order_id, order_date, ship_date,
        coalesce(order_date > ship_date, false) as is_orderdate_gt_shipdate, ship_lead_days
        from clean_orders""",
    "temporal_anomalies": f"""select count(*) filter ({us_date("order_date")}
        > {us_date("ship_date")}) as bad_rows_order_after_ship from ({SHIPMENTS})""",
    "us_date_range": f"""select min({us_date("order_date")}) as date_min,
        max({us_date("order_date")}) as date_max from ({SHIPMENTS})""",
    "anomaly_sample": f"""select order_id, order_date, ship_date, ship_lead_days
        from ({CLEAN_ORDERS}) where is_orderdate_gt_shipdate order by order_id limit 10""",
    "date_window_check": """
        select count(*) filter (l_shipdate::date not between '1996-01-01' and '2000-12-31')
                 as outside_rows,
               min(l_shipdate)::date as observed_min, max(l_shipdate)::date as observed_max
        from lineitem""",
    "days_to_ship": """
        select l_linestatus, min(days)::integer as min_lead, max(days)::integer as max_lead,
               count(*) filter (days < 0) as negative_leads
        from (select l_linestatus, l_shipdate::date - o_orderdate::date as days
              from lineitem join orders on l_orderkey = o_orderkey)
        group by 1""",
    "upsert_scorecard": f"""{with_layer("raw")}, {with_layer("stg").removeprefix("with ")}
        {_union([_completeness(t, "stg" if t in ("customers", "orders", "parts") else "raw")
                 for t in TABLES])}""",
    "insert_missing_tables": f"""{with_layer()}
        {_union([_completeness(t) if t in ("customers", "orders") else MISSING.format(t=t)
                 for t in TABLES])}""",
    "upsert_customer_buckets": """select c_custkey, c_name, c_nationkey,
        greatest(c_acctbal, 0.0) as c_acctbal, c_mktsegment from customer""",
    "upsert_customers": """select c_custkey, c_name, c_nationkey,
        greatest(c_acctbal, 0.0) as c_acctbal, c_mktsegment from customer""",
    "load_summary": f"""select *, (sum("rows") over ())::bigint as total_rows from (
        {_union([f'select {_name(t, "raw")}, count(*) as "rows" from ({RAW[t]})' for t in TABLES])})""",
}
