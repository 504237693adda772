"""The raw, staged and cleaned layers of `inputs` written in SQL."""

from __future__ import annotations



def _day(date: str, by: str, formats: dict[str, str], other: str) -> str:
    cases = "".join(f" when '{k}' then strftime({date}, '{f}')" for k, f in formats.items())
    return f"case {by}{cases} else strftime({date}, '{other}') end"


ORDER_DATES = {
    "1-URGENT": "%Y-%m-%d",
    "2-HIGH": "%m/%d/%Y",
    "3-MEDIUM": "%-m/%-d/%Y",
    "4-NOT SPECIFIED": "%d-%m-%Y",
}

RAW = {
    "customers": """
        select case c_mktsegment when 'BUILDING' then c_custkey || '.0'
                                 when 'MACHINERY' then '00' || c_custkey
                                 else c_custkey::varchar end as customer_id,
               case when c_mktsegment = 'HOUSEHOLD' then '  ' || c_name || ' ' else c_name end
                 as customer_name,
               case when c_acctbal < 0 then '  ' else c_nationkey || '.0' end as nation_id,
               case when c_mktsegment = 'AUTOMOBILE' then format('{:,.2f}', c_acctbal)
                    else c_acctbal::decimal(18,2)::varchar end as account_balance,
               case when c_acctbal < 0 then '' else c_mktsegment end as market_segment
        from customer""",
    "events": """
        select event_id::varchar as event_id,
               strftime(ts, '%Y-%m-%d') as event_date,
               user_id::varchar as user_id,
               case when event_type = 'error' then ' ' else event_type end as event_type,
               "value"::decimal(18,2)::varchar as "value",
               props
        from events""",
    "nations": """
        select n_nationkey::varchar as nation_id, n_name as nation_name,
               n_regionkey::varchar as region_id
        from nation""",
    "order_details": f"""
        select case l_returnflag when 'R' then l_orderkey || '.0' when 'N' then '0' || l_orderkey
                                 else l_orderkey::varchar end as order_id,
               case when l_returnflag = 'A' and l_linestatus = 'F' then ' '
                    when l_linestatus = 'O' then l_partkey || '.00'
                    else l_partkey::varchar end as part_id,
               case when l_returnflag = 'N' and l_linestatus = 'O' then 'S' || l_suppkey
                    else l_suppkey::varchar end as supplier_id,
               l_linenumber::varchar as line_number,
               case when l_returnflag = 'R' then '-' else '' end
                 || l_quantity::decimal(18,2)::varchar as quantity,
               case when l_linestatus = 'O' then format('{{:,.2f}}', l_extendedprice)
                    else l_extendedprice::decimal(18,2)::varchar end as extended_price,
               {_day("l_shipdate", "l_linestatus", {"O": "%d/%m/%Y"}, "%m/%d/%Y")} as ship_date
        from lineitem""",
    "orders": f"""
        select o_orderkey || case when o_orderstatus = 'P' then '.0' else '' end as order_id,
               case when o_orderpriority = '2-HIGH' then o_custkey || '.0'
                    when o_orderpriority = '3-MEDIUM' then o_custkey || '.00'
                    when o_orderpriority = '4-NOT SPECIFIED' and o_orderstatus = 'P' then '  '
                    when o_orderpriority = '5-LOW' and o_orderstatus = 'P' then 'X' || o_custkey
                    when o_orderpriority = '5-LOW' then ' ' || o_custkey
                    else o_custkey::varchar end as customer_id,
               o_orderstatus as order_status,
               case when o_orderstatus = 'P' then format('{{:,.2f}}', o_totalprice)
                    when o_orderpriority = '5-LOW' then '-' || o_totalprice::decimal(18,2)
                    else o_totalprice::decimal(18,2)::varchar end as total_price,
               {_day("o_orderdate", "o_orderpriority", ORDER_DATES, "%Y/%m/%d")} as order_date,
               o_orderpriority as order_priority
        from orders""",
    "parts": """
        select p_partkey::varchar as part_id, p_name as part_name,
               case when p_type = 'ECONOMY' then '' else p_brand end as brand,
               p_type as "type", p_size::varchar as size,
               p_retailprice::decimal(18,2)::varchar as retail_price
        from part""",
    "regions": "select r_regionkey::varchar as region_id, r_name as region_name from region",
    "suppliers": """
        select s_suppkey || '.0' as supplier_id, s_name as supplier_name,
               s_nationkey::varchar as nation_id,
               s_acctbal::decimal(18,2)::varchar as account_balance
        from supplier""",
}

COLUMNS = {
    "customers": "customer_id customer_name nation_id account_balance market_segment".split(),
    "events": "event_id event_date user_id event_type value props".split(),
    "nations": "nation_id nation_name region_id".split(),
    "order_details": (
        "order_id part_id supplier_id line_number quantity extended_price ship_date".split()
    ),
    "orders": "order_id customer_id order_status total_price order_date order_priority".split(),
    "parts": "part_id part_name brand type size retail_price".split(),
    "regions": "region_id region_name".split(),
    "suppliers": "supplier_id supplier_name nation_id account_balance".split(),
}


def staged_key(x: str) -> str:
    return (
        rf"case when regexp_full_match({x}, '[0-9]+(\.0+)?')"
        rf" then regexp_replace(split_part({x}, '.', 1), '^0+([0-9])', '\1')"
        f" else nullif(trim({x}), '') end"
    )


def weak_key(x: str) -> str:
    return rf"nullif(regexp_replace(trim({x}), '\.0$', ''), '')"


def strict_date(x: str) -> str:
    """Year first, or day and month by the two-digit rule."""
    dashed = f"replace({x}, '/', '-')"
    return (
        rf"case when regexp_full_match({x}, '\d{{4}}-\d\d-\d\d|\d{{4}}/\d\d/\d\d')"
        f" then try_strptime({dashed}, '%Y-%m-%d')::date"
        rf" when regexp_full_match({x}, '\d\d-\d\d-\d{{4}}|\d\d/\d\d/\d{{4}}')"
        f" then case when left({x}, 2) <= '12' and substr({x}, 4, 2) > '12'"
        f" then try_strptime({dashed}, '%m-%d-%Y')::date"
        f" else try_strptime({dashed}, '%d-%m-%Y')::date end end"
    )


def us_date(x: str) -> str:
    return (
        rf"case when regexp_full_match({x}, '\d{{1,2}}/\d{{1,2}}/\d{{4}}')"
        f" then try_strptime({x}, '%m/%d/%Y')::date end"
    )


def plain_number(x: str) -> str:
    return (
        rf"case when regexp_full_match({x}, '-?[0-9]+(\.[0-9]+)?')"
        f" then {x}::decimal(38,10) end"
    )


def money_text(x: str) -> str:
    return rf"try_cast(nullif(regexp_replace({x}, '[^0-9.\-]', '', 'g'), '') as decimal(18,2))"


def float_text(x: str) -> str:
    text = rf"regexp_replace({x}, '^\s+|\s+$|,', '', 'g')"
    shape = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    return f"case when regexp_full_match({text}, '{shape}') then try_cast({text} as double) end"


def staged(table: str) -> str:
    cells = [
        f'{staged_key(c) if c.endswith("_id") else f"""nullif(trim("{c}"), \'\')"""} as "{c}"'
        for c in COLUMNS[table]
    ]
    return f"select {', '.join(cells)} from ({RAW[table]})"


def with_layer(kind: str = "stg", tables: list[str] | None = None) -> str:
    """`with stg_orders as (...), ...`: the layer's tables as CTEs."""
    build = staged if kind == "stg" else RAW.get
    return "with " + ", ".join(f"{kind}_{t} as ({build(t)})" for t in tables or RAW)


SHIPMENTS = f"""
    select o_orderkey || '.0' as order_id,
           o_custkey::varchar as customer_id,
           {_day("o_orderdate", "o_orderpriority", {"5-LOW": "%Y/%m/%d"}, "%-m/%-d/%Y")}
             as order_date,
           case when o_orderstatus = 'P' then '  ' else strftime(first_ship, '%m/%d/%Y') end
             as ship_date,
           format('{{:,.2f}}', o_totalprice) as freight_charge
    from orders
    left join (select l_orderkey, min(l_shipdate) as first_ship from lineitem group by 1)
      on l_orderkey = o_orderkey"""

PRODUCTS = """
    select p_partkey::varchar as product_id, p_name as product_name,
           case when p_type <> 'ECONOMY' then split_part(p_name, ' ', 1) end as color,
           format('{:,.2f}', p_retailprice) as purchase_price
    from part"""

CLEAN_ORDERS = f"""
    select {staged_key("order_id")} as order_id, {staged_key("customer_id")} as customer_id,
           od as order_date, sd as ship_date, {money_text("freight_charge")} as freight_charge,
           coalesce(od > sd, false) as is_orderdate_gt_shipdate,
           (sd - od)::integer as ship_lead_days
    from (select *, try_strptime(order_date, '%m/%d/%Y')::date as od,
                 try_strptime(ship_date, '%m/%d/%Y')::date as sd from ({SHIPMENTS}))"""

FACT_LAYER = """
    with clean_customers as (
      select c_custkey as customer_id, c_name as customer_name, r_name as region,
             n_name as country, c_mktsegment as customer_class, c_nationkey as price_category,
             c_acctbal < 0 as gone
      from customer left join nation on n_nationkey = c_nationkey
                    left join region on r_regionkey = n_regionkey),
    shipped as (select l_orderkey, min(l_shipdate)::date as ship_date from lineitem group by 1),
    clean_orders as (
      select o_orderkey as order_id, o_custkey as customer_id, o_orderdate::date as order_date,
             ship_date, o_totalprice::decimal(18,2) as freight_charge,
             (ship_date - o_orderdate::date)::integer as ship_lead_days
      from orders left join shipped on l_orderkey = o_orderkey),
    lines as (
      select l_orderkey as order_id, count(*) as line_count,
             sum(l_quantity::integer)::decimal(38,10) as item_qty,
             sum(l_quantity::integer * l_extendedprice::decimal(18,2))::decimal(18,2) as gross_sales
      from lineitem where true group by 1),
    pays as (
      select l_orderkey as order_id, count(*) as payment_cnt,
             sum(l_extendedprice::decimal(18,2))::decimal(18,2) as paid_amount
      from lineitem where l_linestatus = 'F' group by 1)"""


def fact_sql(first: int, last: int, sold: str = "true") -> str:
    return f"""{FACT_LAYER.replace("true", sold)},
    fact as (
      select o.order_id, o.order_date, o.ship_date, o.customer_id, c.customer_name, c.region,
             c.country, c.customer_class, c.price_category, o.ship_lead_days,
             coalesce(l.line_count, 0) as line_count,
             coalesce(l.item_qty, 0)::decimal(38,10) as item_qty,
             coalesce(l.gross_sales, 0)::decimal(18,2) as gross_sales, o.freight_charge,
             (coalesce(l.gross_sales, 0) + o.freight_charge)::decimal(18,2) as order_total,
             coalesce(p.paid_amount, 0)::decimal(18,2) as paid_amount,
             coalesce(p.payment_cnt, 0) as payment_cnt
      from clean_orders o join clean_customers c using (customer_id)
           left join lines l using (order_id) left join pays p using (order_id)
      where not c.gone and o.ship_lead_days between {first} and {last} and o.freight_charge >= 0)
    select *, (order_total - paid_amount)::decimal(18,2) as unpaid_amount,
           row_number() over w as order_seq,
           (order_date - lag(order_date) over w)::integer as days_since_prev_order,
           (sum(order_total) over (w rows unbounded preceding))::decimal(18,2)
             as customer_running_spend
    from fact window w as (partition by customer_id order by order_date, order_id)
    order by order_date desc, order_id desc"""
