"""SQL for every registered query, over the given tables only."""

from __future__ import annotations

CATALOG = """
event_catalog as (
  select 'E' || p_partkey as event_id, p_name as event_name, n_name as city, p_type as category,
         cast(p_retailprice as decimal(10,2)) as base_ticket_price
  from part join nation on p_partkey % 25 = n_nationkey)"""

RAW = """
records as (
  select case when event_id % 50 <> 17 then 'E' || user_id end as key, ts, event_id as seq, event_type, value,
         'E' || user_id as event_id
  from events),
raw_sales as (
  select key, ts, seq, 'S' || seq as sale_id, event_id,
         case seq % 3 when 1 then 'VIP' when 2 then 'STUDENT' else 'NORMAL' end as ticket_type,
         cast(3 + seq % 8 as integer) as quantity
  from records where event_type <> 'error'),
raw_expenses as (
  select key, ts, seq, 'X' || seq as expense_id, event_id,
         case seq % 5 when 0 then 'venue' when 1 then 'security' when 2 then 'marketing' when 3 then 'staff'
                      else 'equipment' end as expense_type,
         cast((50 + floor(value)) * 100 as double) as cost
  from records where event_type = 'error')"""

RATE = """case ticket_type when 'VIP' then cast(1.8 as double) when 'STUDENT' then cast(0.7 as double)
          else cast(1.0 as double) end"""

VIEWS = f"""{CATALOG},{RAW},
sales as (
  select r.key, r.ts, r.seq, r.sale_id, r.event_id,
         case when r.seq % 4 = 0 then c.event_name || ' (renamed)' else c.event_name end as event_name,
         n_name as city, c.category, r.ticket_type,
         cast(c.base_ticket_price as double) * {RATE} as ticket_price, r.quantity,
         cast(c.base_ticket_price as double) * {RATE} * r.quantity as amount
  from raw_sales r join event_catalog c using (event_id) join nation on r.seq % 25 = n_nationkey),
expenses as (
  select r.key, r.ts, r.seq, r.expense_id, r.event_id, c.event_name, r.expense_type, r.cost, r.cost as amount
  from raw_expenses r join event_catalog c using (event_id))"""

BULK = """
sales as (
  select 'E' || l_suppkey as key, l_shipdate as ts, l_orderkey * 8 + l_linenumber as seq, 'E' || l_suppkey as event_id, s_name as event_name, n_name as city,
         p_retailprice * case l_returnflag when 'A' then cast(1.8 as double) when 'R' then cast(0.7 as double)
                         else cast(1.0 as double) end * cast(l_quantity as integer) as amount
  from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey
  join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
  join nation on n_nationkey = c_nationkey
  where l_linestatus = 'F'),
expenses as (
  select 'E' || l_suppkey as key, l_shipdate as ts, l_orderkey * 8 + l_linenumber as seq, 'E' || l_suppkey as event_id, s_name as event_name,
         l_extendedprice * l_discount as amount
  from lineitem join supplier on s_suppkey = l_suppkey
  where l_linestatus = 'O')"""

# The same with exact amounts, so that running totals tie where they should.
_EXACT = BULK.replace("sales as (", "sales as (select * replace (cast(amount as decimal(28,6)) as amount) from (", 1).replace(
    "where l_linestatus = 'F')", "where l_linestatus = 'F'))").replace(
    "expenses as (", "expenses as (select * replace (cast(amount as decimal(28,6)) as amount) from (").replace(
    "where l_linestatus = 'O')", "where l_linestatus = 'O'))")

# (id, eventName) of the first record of each key.
FIRSTS = """
sale_firsts as (select key, event_id as id, event_name as "eventName" from sales where key is not null
                qualify row_number() over (partition by key order by ts, seq) = 1),
expense_firsts as (select key, event_id as id, event_name as "eventName" from expenses where key is not null
                   qualify row_number() over (partition by key order by ts, seq) = 1)"""


def _with(views: str, body: str) -> str:
    return f"with {views}{body}"


def _per_event(side: str, firsts: str) -> str:
    return f""" select f.key, f.id, f."eventName", t.value from {firsts} f
      join (select key, round(sum(amount), 3) as value from {side} group by key) t on t.key = f.key"""


def _total(side: str, ident: str, name: str) -> str:
    return f""" select 'TOTAL' as key, '{ident}' as id, '{name}' as "eventName", round(sum(amount), 3) as value
      from {side} having count(*) > 0"""


def _per_minute(side: str, ident: str, name: str) -> str:
    return f""" select '{ident}_' || epoch_ms(w) as key, '{ident}' as id, '{name}' as "eventName",
      round(sum(amount), 3) as value, w as window_start
      from (select date_trunc('minute', ts) as w, amount from {side}) group by w"""


_PROFIT_PER_EVENT = """ select f.key, f.id, f."eventName", round(r.total - x.total, 3) as value
  from sale_firsts f join (select key, sum(amount) as total from sales group by key) r on r.key = f.key
  join (select key, sum(amount) as total from expenses group by key) x on x.key = f.key"""

_TOTAL_PROFIT = """ select 'TOTAL' as key, 'TOTAL_PROFIT' as id, 'Total Profit' as "eventName",
  round(r.total - x.total, 3) as value
  from (select sum(amount) as total from sales) r, (select sum(amount) as total from expenses) x
  where r.total is not null and x.total is not null"""

_AVERAGE_PER_EVENT = """ select key, 'AVG_PER_EVENT' as id, 'Average Ticket Sale Per Event' as "eventName",
  round(avg(amount) + 1.23e-7, 4) as value from sales where key is not null group by key"""

_AVERAGE_ALL = """ select 'TOTAL' as key, 'AVG_ALL_EVENTS' as id, 'Average Ticket Sale All Events' as "eventName",
  round(avg(amount) + 1.23e-7, 4) as value from sales having count(*) > 0"""

_PROFIT_PER_MINUTE = """ select 'TOTAL_PROFIT_WINDOWED_' || epoch_ms(w) as key, 'TOTAL_PROFIT_WINDOWED' as id,
  'Total Profit Windowed' as "eventName", round(r.total - x.total, 3) as value, w as window_start
  from (select date_trunc('minute', ts) as w, sum(amount) as total from sales group by 1) r
  join (select date_trunc('minute', ts) as w, sum(amount) as total from expenses group by 1) x using (w)"""

_CITY_SALES = """ select event_id as key, event_id as id, city as "eventName", round(sum(amount), 3) as value
  from sales group by event_id, city"""

PROFIT_LOG = """
profit_log as (
  select key, ts, seq, round(earned - spent, 3) as value, n_sales, n_expenses from (
    select key, ts, seq,
           sum(case when sale then amount else 0 end) over w as earned,
           sum(case when sale then 0 else amount end) over w as spent,
           sum(case when sale then 1 else 0 end) over w as n_sales,
           sum(case when sale then 0 else 1 end) over w as n_expenses
    from (select key, ts, seq, amount, true as sale from sales where key is not null
          union all select key, ts, seq, amount, false from expenses where key is not null)
    window w as (partition by key order by ts, seq rows unbounded preceding))
  where n_sales > 0 and n_expenses > 0)"""

_HIGHEST_PROFIT = """ select 'HIGHEST_PROFIT_EVENT' as key, 'HIGHEST_PROFIT_EVENT' as id, f."eventName", p.value
  from (select * from profit_log order by value desc, ts, seq limit 1) p join sale_firsts f on f.key = p.key"""

# The very first profit update passes through under its own event id; later ones carry the constant id.
_HIGHEST_PROFIT_TABLE = """ select f.id, f."eventName", p.value
  from (select * from profit_log order by ts, seq limit 1) p join sale_firsts f on f.key = p.key
  union all
  select 'HIGHEST_PROFIT_EVENT', f."eventName", p.value
  from (select * from profit_log order by value desc, ts, seq limit 1) p join sale_firsts f on f.key = p.key
  where (select count(*) from profit_log) > 1"""

_BEST_CITY = """ select event_id as key, event_id as id, city as "eventName", value from (
    select event_id, city, ts, seq,
           round(sum(amount) over (partition by event_id, city order by ts, seq rows unbounded preceding), 3) as value
    from sales)
  qualify row_number() over (partition by event_id order by value desc, ts, seq) = 1"""

_BARRED = """ select split_part(event_id, '|', 1) as key, event_id as id, city as "eventName", value from (
    select event_id, city, ts, seq,
           round(sum(amount) over (partition by event_id, city order by ts, seq rows unbounded preceding), 3) as value
    from (select * replace (case when seq % 3 = 0 then event_id || '|' || (seq % 2) else event_id end as event_id) from sales))
  qualify row_number() over (partition by split_part(event_id, '|', 1) order by value desc, ts, seq) = 1"""

_AVERAGE_TABLE = """ select 'AVG_PER_EVENT' as id, 'Average Ticket Sale Per Event' as "eventName",
  round(avg(amount) + 1.23e-7, 4) as value from sales
  where key = (select key from sales where key is not null order by ts desc, seq desc limit 1) having count(*) > 0"""


def _last_minute(side: str, ident: str, name: str) -> str:
    return f""" select '{ident}' as id, '{name}' as "eventName", round(sum(amount), 3) as value from {side}
      where date_trunc('minute', ts) = (select date_trunc('minute', max(ts)) from {side}) having count(*) > 0"""


_PROFIT_LAST_MINUTE = """ select 'TOTAL_PROFIT_WINDOWED' as id, 'Total Profit Windowed' as "eventName",
  round(r.total - x.total, 3) as value
  from (select date_trunc('minute', ts) as w, sum(amount) as total from sales group by 1) r
  join (select date_trunc('minute', ts) as w, sum(amount) as total from expenses group by 1) x using (w)
  order by w desc limit 1"""


def results() -> dict[str, str]:
    """The thirteen results, and the running table behind the last."""
    return {
        "revenue_per_event": _with(VIEWS + "," + FIRSTS, _per_event("sales", "sale_firsts")),
        "expenses_per_event": _with(VIEWS + "," + FIRSTS, _per_event("expenses", "expense_firsts")),
        "profit_per_event": _with(VIEWS + "," + FIRSTS, _PROFIT_PER_EVENT),
        "total_revenue": _with(VIEWS, _total("sales", "TOTAL_REVENUE", "Total Revenue")),
        "total_expenses": _with(VIEWS, _total("expenses", "TOTAL_EXPENSES", "Total Expenses")),
        "total_profit": _with(VIEWS, _TOTAL_PROFIT),
        "average_sale_per_event": _with(VIEWS, _AVERAGE_PER_EVENT),
        "average_sale_all_events": _with(VIEWS, _AVERAGE_ALL),
        "highest_profit_event": _with(VIEWS + "," + FIRSTS + "," + PROFIT_LOG, _HIGHEST_PROFIT),
        "revenue_per_minute": _with(VIEWS, _per_minute("sales", "TOTAL_REVENUE_WINDOWED", "Total Revenue Windowed")),
        "expenses_per_minute": _with(
            VIEWS, _per_minute("expenses", "TOTAL_EXPENSES_WINDOWED", "Total Expenses Windowed")),
        "profit_per_minute": _with(VIEWS, _PROFIT_PER_MINUTE),
        "city_highest_sales_per_event": _with(VIEWS, _BEST_CITY),
    }


def table_views() -> dict[str, str]:
    """Results as their tables show them: one row per `id`, last writer wins."""
    return {
        "average_sale_table": _with(VIEWS, _AVERAGE_TABLE),
        "revenue_last_minute": _with(VIEWS, _last_minute("sales", "TOTAL_REVENUE_WINDOWED", "Total Revenue Windowed")),
        "expenses_last_minute": _with(
            VIEWS, _last_minute("expenses", "TOTAL_EXPENSES_WINDOWED", "Total Expenses Windowed")),
        "profit_last_minute": _with(VIEWS, _PROFIT_LAST_MINUTE),
        "highest_profit_table": _with(VIEWS + "," + FIRSTS + "," + PROFIT_LOG, _HIGHEST_PROFIT_TABLE),
    }


def bulk() -> dict[str, str]:
    """Order-free results over the largest table."""
    named = """,
sale_firsts as (select distinct key, event_id as id, event_name as "eventName" from sales),
expense_firsts as (select distinct key, event_id as id, event_name as "eventName" from expenses)"""
    exact = {
        "bulk_revenue_per_event": _with(BULK + named, _per_event("sales", "sale_firsts")),
        "bulk_expenses_per_event": _with(BULK + named, _per_event("expenses", "expense_firsts")),
        "bulk_profit_per_event": _with(BULK + named, _PROFIT_PER_EVENT),
        "bulk_total_profit": _with(BULK, _TOTAL_PROFIT),
        "bulk_average_sale_per_event": _with(BULK, _AVERAGE_PER_EVENT),
        "bulk_revenue_per_minute": _with(
            BULK, _per_minute("sales", "TOTAL_REVENUE_WINDOWED", "Total Revenue Windowed")),
        "bulk_profit_per_minute": _with(BULK, _PROFIT_PER_MINUTE),
        "bulk_city_sales_per_event": _with(BULK, _CITY_SALES),
    }
    # Expenses have four decimals here (price x discount).
    out = {name: sql.replace(", 3) as value", ", 4) as value") for name, sql in exact.items()}
    marks = {"bulk_highest_profit_event": _HIGHEST_PROFIT, "bulk_highest_profit_table": _HIGHEST_PROFIT_TABLE,
             "bulk_city_highest_sales_per_event": _BEST_CITY}
    log = PROFIT_LOG.replace("round(earned - spent, 3)", "earned - spent")
    for name, body in marks.items():
        body = body.replace("p.value", "round(cast(p.value as double), 4) as value").replace("round(sum(amount)", "(sum(amount)")
        body = body.replace("rows unbounded preceding), 3)", "rows unbounded preceding))").replace(
            "city as \"eventName\", value from", "city as \"eventName\", round(cast(value as double), 4) as value from")
        out[name] = _with(_EXACT + named + "," + log, body)
    return out


# Late records, as in views.delayed_sales: stream time is the latest time seen by then, and a window closes 23 h 59 min after its end.
_GRACED = """ select * replace (case when seq % 7 = 3 then ts - to_days((case when seq % 5 = 0 then seq % 4 else 0 end)::integer)
    - to_minutes(23 * 60 + 50 + seq % 20) else ts end as ts) from {0}"""


def _graced(side: str) -> str:
    return f"""{side}_in_time as (
      select * from (select *, max(ts) over (order by seq rows unbounded preceding) as stream_time from ({_GRACED.format(side)}))
      where date_trunc('minute', ts) + interval 1 minute > stream_time - interval '23 hours 59 minutes')"""


_COPIES = """
copies as (
  select t as snapshot_ts, event_id, event_name || ' #' || n as event_name, city, category,
         cast(base_ticket_price + case when substr(event_id, 2)::bigint % 3 = 0 then 0 else 10 * n end as decimal(10,2)) as base_ticket_price
  from event_catalog, (values (timestamp '2024-01-03 00:00:00', 0), (timestamp '2024-01-12 00:00:00', 1), (timestamp '2024-01-20 06:30:00', 2)) v(t, n)
  where (substr(event_id, 2)::bigint + n) % 9 <> 0)"""


def _running(entries: str, key: str, conditions: str = "true") -> str:
    """Both sides' totals after each entry of (key, ts, seq, amount, sale)."""
    return f"""(select * from (
      select {key} as key, ts, seq, sum(case when sale then amount end) over w as earned, sum(case when not sale then amount end) over w as spent,
             count(*) filter (sale) over w as n
      from ({entries}) window w as (partition by {key} order by ts, seq rows unbounded preceding)) where {conditions})"""


def changelogs() -> dict[str, str]:
    """Every update of a result, and the last one of each key in every 30 seconds."""
    sale, expense = "select key, ts, seq, amount, true as sale from sales", "select key, ts, seq, amount, false as sale from expenses"
    keyed = " where key is not null"
    both, known = f"{sale} union all {expense}", "earned is not null and spent is not null"
    logs = {
        "revenue_per_event": (_running(sale + keyed, "key"), "earned", "sale_firsts"),
        "profit_per_event": (_running(f"{sale}{keyed} union all {expense}{keyed}", "key", known), "earned - spent", "sale_firsts"),
        "total_revenue": (_running(sale, "'TOTAL'"), "earned", ("TOTAL_REVENUE", "Total Revenue")),
        "total_expenses": (_running(expense, "'TOTAL'"), "spent", ("TOTAL_EXPENSES", "Total Expenses")),
        "total_profit": (_running(both, "'TOTAL'", known), "earned - spent", ("TOTAL_PROFIT", "Total Profit")),
        "average_sale_per_event": (_running(sale + keyed, "key"), "earned / n", ("AVG_PER_EVENT", "Average Ticket Sale Per Event")),
    }

    def sql(name: str, flushed: bool = False, places: int = 3) -> str:
        rows, value, label = logs[name]
        if flushed:
            rows = f"""(select *, time_bucket(interval 30 seconds, ts) as slot from {rows}
                        qualify row_number() over (partition by key, time_bucket(interval 30 seconds, ts) order by ts desc, seq desc) = 1)"""
        value = "round(earned / n + 1.23e-7, 4)" if name.startswith("average") else f"round({value}, {places})"
        slot = ", slot" if flushed else ""
        if isinstance(label, tuple):
            return f""" select key, '{label[0]}' as id, '{label[1]}' as "eventName", {value} as value, seq{slot} from {rows} r"""
        return f""" select r.key, f.id, f."eventName", {value} as value, seq{slot} from {rows} r join {label} f on f.key = r.key"""

    highest = """ select 'HIGHEST_PROFIT_EVENT' as key, case when nth = 1 then f.id else 'HIGHEST_PROFIT_EVENT' end as id, f."eventName", best.value, p.seq
      from (select seq, row_number() over w as nth, max({'value': value, 'ts': -epoch_us(ts), 'seq': -seq, 'key': key}) over w as best
            from profit_log window w as (order by ts, seq rows unbounded preceding)) p join sale_firsts f on f.key = p.best.key"""
    return {
        **{f"{name}_changes": _with(VIEWS + "," + FIRSTS, sql(name)) for name in logs},
        **{f"{name}_flushed": _with(VIEWS + "," + FIRSTS, sql(name, flushed=True)) for name in ("revenue_per_event", "profit_per_event", "total_revenue")},
        "bulk_profit_per_event_flushed": _with(f"""{_EXACT},
            sale_firsts as (select distinct key, event_id as id, event_name as "eventName" from sales)""",
            sql("profit_per_event", True, 4).replace("round(earned - spent, 4)", "round(cast(earned - spent as double), 4)")),
        "highest_profit_changes": _with(VIEWS + "," + FIRSTS + "," + PROFIT_LOG, highest),
    }


def graced() -> dict[str, str]:
    in_time = f"{VIEWS},{_graced('sales')},{_graced('expenses')}"
    return {
        "revenue_per_minute_graced": _with(in_time, _per_minute("sales_in_time", "TOTAL_REVENUE_WINDOWED", "Total Revenue Windowed")),
        "expenses_per_minute_graced": _with(in_time, _per_minute("expenses_in_time", "TOTAL_EXPENSES_WINDOWED", "Total Expenses Windowed")),
        "profit_per_minute_graced": _with(in_time, _PROFIT_PER_MINUTE.replace("from sales", "from sales_in_time").replace(
            "from expenses", "from expenses_in_time")),
    }


# Altered sale records, as in views.sales_topic.
TOPIC = """,
altered as (
  select s.*, seq % 16 as kind,
         case seq % 16 when 0 then 'empty value' when 1 then 'empty value' when 2 then 'unreadable JSON'
                       when 3 then 'unreadable JSON' when 4 then 'bad ticketPrice' when 5 then 'bad quantity'
                       when 8 then 'unreadable JSON' when 9 then 'unreadable JSON' end as reason
  from sales s)"""

CITY_REQUESTS = """
requests as (
  select c_custkey as seq,
         case c_custkey % 7 when 0 then '  ' when 1 then 'NATION_' || c_nationkey when 2 then repeat('x', 101)
                            else 'City ' || (c_custkey // 3) end as city_name
  from customer),
checked as (
  select *, case when trim(city_name) = '' then 'missing city_name'
                 when length(city_name) > 100 then 'city_name is longer than 100' end as problem
  from requests),
judged as (
  select seq, city_name, coalesce(problem, case
           when city_name in (select n_name from nation)
             or row_number() over (partition by city_name, problem is null order by seq) > 1
           then 'city_name already exists' end) as reason
  from checked)"""

EVENT_REQUESTS = """
requests as (
  select c_custkey as seq,
         case when c_custkey % 13 = 4 then rpad('E' || (c_custkey // 2 * 4), 21, '0')
              else 'E' || (c_custkey // 2 * 4) end as event_id,
         case when c_custkey % 13 = 0 then ' ' else c_name end as event_name,
         case when c_custkey % 13 <> 1 then 'City ' || c_nationkey end as city, c_mktsegment as category,
         case c_custkey % 13 when 2 then 'abc' when 3 then '100000000' when 5 then '12.345' when 6 then ''
              else (10 + c_custkey % 50) || '.5' end as base_ticket_price
  from customer),
checked as (
  select *, case when trim(event_name) = '' then 'missing event_name' when city is null then 'missing city'
                 when trim(base_ticket_price) = '' then 'missing base_ticket_price'
                 when try_cast(base_ticket_price as double) is null then 'base_ticket_price is not a number'
                 when length(event_id) > 20 then 'event_id is longer than 20'
                 when try_cast(base_ticket_price as decimal(10,2)) is null
                 then 'base_ticket_price is out of range' end as problem
  from requests),
judged as (
  select seq, event_id, event_name, city, category, base_ticket_price, coalesce(problem, case
           when event_id in (select 'E' || p_partkey from part)
             or row_number() over (partition by event_id, problem is null order by seq) > 1
           then 'event_id already exists' end) as reason
  from checked)"""


def _clip(column: str, width: int) -> str:
    return (f"case when {column} is null then '-' when length({column}) <= {width} then {column} "
            f"else left({column}, {width - 3}) || '...' end")


def _euros(value: str, width: int) -> str:
    return f"printf('€ %{width}.2f', cast(round(cast({value} as decimal(18,3)), 2) as double))"


def catalog() -> dict[str, str]:
    return {
        "city_list": 'select n_nationkey as "cityId", n_name as "cityName" from nation order by 1',
        "catalog_list": f"""with {CATALOG} select event_id as "eventId", event_name as "eventName", city, category,
            base_ticket_price as "baseTicketPrice" from event_catalog order by event_id""",
        "catalog_snapshots": f"""with {CATALOG} select event_id, event_name, city, category, base_ticket_price,
            t as snapshot_ts from event_catalog,
            (values (timestamp '2026-01-01 00:00:00'), (timestamp '2026-01-01 00:01:00')) v(t)""",
        "catalog_report": f"""with {CATALOG} select {_clip('event_id', 6)} as event_id,
            {_clip('event_name', 20)} as event_name, {_clip('city', 12)} as city, {_clip('category', 14)} as category,
            {_euros('base_ticket_price', 8)} as base_ticket_price from event_catalog""",
        "sales_priced": f"""with {CATALOG},{RAW} select r.key, r.ts, r.seq, r.sale_id, r.event_id, c.event_name, c.city,
            c.category, r.ticket_type, round(cast(c.base_ticket_price as double) * {RATE}, 3) as ticket_price, r.quantity
            from raw_sales r join event_catalog c using (event_id)""",
        "sales_priced_asof": f"""with {CATALOG},{RAW},{_COPIES} select r.key, r.ts, r.seq, r.sale_id, r.event_id, c.event_name, c.city,
            c.category, r.ticket_type, round(cast(c.base_ticket_price as double) * {RATE}, 3) as ticket_price, r.quantity
            from raw_sales r join copies c on c.event_id = r.event_id
            and c.snapshot_ts = (select max(snapshot_ts) from copies where snapshot_ts <= r.ts)""",
        "expenses_named": f"""with {VIEWS} select key, ts, seq, expense_id, event_id, event_name, expense_type, cost
            from expenses""",
        "append_cities": f"""with {CITY_REQUESTS} select seq,
            cast((select max(n_nationkey) from nation) + row_number() over (order by seq) as integer) as city_id,
            city_name from judged where reason is null""",
        "append_cities_twice": f"""with {CITY_REQUESTS.replace("order by seq", "order by seq % 2 = 0, seq")} select cast(
            (select max(n_nationkey) from nation) + row_number() over (order by seq % 2 = 0, seq) as integer) as city_id,
            city_name from judged where reason is null
            union all select cast(n_nationkey as integer), n_name from nation""",
        "append_trimmed": f"""with {CITY_REQUESTS} select seq,
            cast((select max(n_nationkey) from nation) + row_number() over (order by seq) as integer) as city_id,
            city_name from judged where reason is null""",
        "append_cities_rejected": f"""with {CITY_REQUESTS} select seq, city_name, reason from judged
            where reason is not null""",
        "append_events": f"""with {EVENT_REQUESTS} select seq, event_id, event_name, city, category,
            cast(base_ticket_price as decimal(10,2)) as base_ticket_price from judged where reason is null""",
        "append_events_rejected": f"""with {EVENT_REQUESTS} select seq, event_id, event_name, city, category,
            base_ticket_price, reason from judged where reason is not null""",
    }


def records() -> dict[str, str]:
    sale = "key, ts, seq * 2 as seq, sale_id, event_id, event_name, city, category, ticket_type"
    profit = results()["profit_per_event"]
    return {
        "decode_sales": _with(VIEWS + TOPIC, f""" select {sale}, quantity,
            case when kind = 6 then 0.0 else round(ticket_price, 3) end as ticket_price from altered
            where reason is null"""),
        "quarantine_sales": _with(VIEWS + TOPIC, """ select key, ts, seq * 2 as seq, reason from altered
            where reason is not null"""),
        "quarantine_untimed": _with(VIEWS, """ select key, case when seq % 16 = 1 then timestamp '1969-12-31 23:59:59' end as ts,
            seq * 2 as seq, 'bad timestamp' as reason from sales where seq % 16 < 2"""),
        "decode_expenses": _with(VIEWS, """ select key, ts, seq * 2 + 1 as seq, expense_id, event_id, event_name,
            expense_type, cost from expenses"""),
        "result_envelope": profit,
        "result_report": f"""select {_clip('id', 28)} as id, {_clip('"eventName"', 30)} as "eventName",
            {_euros('value', 10)} as value from ({profit}) p""",
        "read_result": f'select id, "eventName", value from ({profit}) p order by id',
    }


def streamed() -> dict[str, str]:
    """What streams leave behind besides their tables."""
    third = "least(floor((epoch_us(ts) - lo) * 3 / (hi - lo + 1)), 2)::integer"
    return {
        **{f"state_{name}": results()[name] for name in ("total_revenue", "revenue_per_event", "profit_per_event")},
        "average_sale_by_functions": results()["average_sale_per_event"],
        "stream_sales_priced": catalog()["sales_priced"],
        "stream_quarantine_sales": records()["quarantine_sales"],
        "stream_quarantine_counts": _with(VIEWS + TOPIC, " select coalesce(reason, 'good') as reason, count(*) as n from altered group by 1"),
        # The topics are written in three parts by time, one micro-batch each.
        "stream_changes_revenue_per_event": _with(VIEWS + "," + FIRSTS, f""" select r.key, b, f.id, f."eventName", value
            from (select key, b, round(sum(total) over (partition by key order by b), 3) as value
                  from (select key, {third} as b, sum(amount) as total from sales, (select epoch_us(min(ts)) as lo, epoch_us(max(ts)) as hi from events)
                        where key is not null group by 1, 2)) r join sale_firsts f on f.key = r.key"""),
        "append_events_twice": f"""with {CATALOG},{EVENT_REQUESTS.replace("order by seq", "order by seq % 2 = 0, seq")}
            select event_id, event_name, city, category, cast(base_ticket_price as decimal(10,2)) as base_ticket_price from judged where reason is null
            union all select * from event_catalog""",
    }


def all_sql() -> dict[str, str]:
    # Event ids of the plain views hold no bar, so there the strict key changes nothing.
    city = {"city_highest_sales_barred": _with(VIEWS, _BARRED),
            "city_sales_per_event": _with(VIEWS, _CITY_SALES), "city_highest_sales_strict": _with(VIEWS, _BEST_CITY)}
    streams = {f"stream_{name}": sql for name, sql in {**results(), **table_views()}.items()}
    streams["stream_total_revenue_replayed"] = results()["total_revenue"]
    return {**results(), **city, **table_views(), **bulk(), **catalog(), **records(), **changelogs(), **graced(), **streamed(), **streams}
