"""Common table expressions shared by the DuckDB statements."""

BARS = """bars as (select p_brand as sym, cast(date_trunc('week', l_shipdate) as date) as d,
  floor(avg(l_extendedprice / l_quantity) * 1000 + 0.37) / 1000 as close, sum(l_quantity) as volume
  from lineitem join part on l_partkey = p_partkey group by 1, 2)"""
MACRO = """macro as (select d, floor((10 + (x / 100) % 35.0::double) * 1000 + 0.37) / 1000 as vix
  from (select cast(o_orderdate as date) as d, avg(o_totalprice) as x from orders group by 1))"""
SECTOR = """sector as (select n_name as sym, r_name as sector, cast(date_trunc('week', o_orderdate) as date) as d, floor(avg(o_totalprice) * 1000 + 0.37) / 1000 as close
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2, 3)"""
TRADES = """trades as (select o_orderkey as trade_id, cast(o_orderdate as date) as d, 'P' || (o_custkey % 40) as pair,
  case when (o_orderkey * 13) % 7 < 4 then 'LONG' else 'SHORT' end as action, ((o_orderkey * 7919) % 2001 - 1000) / 20000.0::double as net_pnl_pct,
  ((o_orderkey * 7919) % 2001 - 1000) * 50.0::double as pnl_dollar, cast((o_orderkey * 31) % 25 + 1 as int) as holding_days,
  0.5::double + (o_orderkey * 17) % 501 / 1000.0::double as strength, 1.8::double + (o_orderkey * 29) % 1700 / 1000.0::double as zscore,
  cast(20 + (o_orderkey * 37) % 180 as double) as px_long, cast(20 + (o_orderkey * 41) % 180 as double) as px_short,
  ['AAPL', 'IBM', 'GOOGL', 'BRK-B'][cast(o_orderkey % 4 + 1 as int)] as short_sym from orders)"""
DAILY = TRADES + """, daily as (select d, floor(avg(net_pnl_pct) * 100000 + 0.37) / 100000 as pnl from trades group by d)"""
PAIRS = BARS + """, joined as (select a.sym as s1, b.sym as s2, a.d, a.close as p1, b.close as p2 from bars a join bars b on a.d = b.d and a.sym < b.sym)"""
SPREAD = PAIRS + """, spread as (select s1, s2, d, ln(p1 + 1e-8) - ln(p2 + 1e-8) as s from joined)"""
