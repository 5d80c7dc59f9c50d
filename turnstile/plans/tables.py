"""Results as result tables: one row per `id`, the last writer's."""

from __future__ import annotations

from pyspark.sql import DataFrame

from turnstile.constants import TOTAL_KEY
from turnstile.operators.ledger import ledger
from turnstile.plans.results import highest_profit_event
from turnstile.session import materialise


def table_view(result: DataFrame) -> DataFrame:
    """`id, eventName, value` of the row updated last, for every `id`.

    Results whose rows share a constant `id` (the per-event averages, the minute windows) show one row: the event or
    minute that was updated last.
    """
    return result.sparkSession.sql("""
        select id, last.* from (select id, max_by(struct(eventName, value), pos) as last from {result} group by id)""",
                                   result=result)


def first_profit_update(sales: DataFrame, expenses: DataFrame) -> DataFrame:
    """`id, eventName, value, more` of the very first profit any event showed; `more` if others followed.

    The first record of a running maximum is kept as it came, under its event's own id.
    """
    entries = ledger(sales, expenses).where("key is not null")
    # `earliest` is one row: the event whose second side came first.
    return entries.sparkSession.sql(f"""
        with sides as (
          select key, min(if(is_sale, pos, null)) as sale, min(if(is_sale, null, pos)) as expense, max(pos) as last
          from {{entries}} group by key),
        earliest as (
          select min_by(struct(key, greatest(sale, expense) as start, sale), greatest(sale, expense)) as f,
                 count(*) > 1 or max(last > greatest(sale, expense)) as more
          from sides where sale is not null and expense is not null group by '{TOTAL_KEY}')
        select max(if(e.pos = f.sale, e.id, null)) as id, max(if(e.pos = f.sale, e.name, null)) as eventName,
               sum(if(e.is_sale, e.amount, -e.amount)) as value, any_value(more) as more
        from {{entries}} e join (select /*+ broadcast */ * from earliest) on e.key = f.key and e.pos <= f.start
        group by e.key""", entries=entries)


def highest_profit_table(sales: DataFrame, expenses: DataFrame) -> DataFrame:
    """The result table of `highest_profit_event`: the first update stays behind under its event's id."""
    first = materialise(first_profit_update(sales, expenses), "first")  # one row, used twice
    best = highest_profit_event(sales, expenses)
    return first.sparkSession.sql("""
        select id, eventName, value from {first}
        union all
        select b.id, b.eventName, b.value from {best} b where exists (select 1 from {first} where more)""",
                                  first=first, best=best)
