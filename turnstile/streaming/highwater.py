"""The high-water results over a stream.

Each micro-batch is solved by the batch operator, the totals so far of the batch's members entering as one cell each.
Totals, bests and event names are upsert tables whose version is the batch id: a replayed batch starts from the version
before its own, and a batch writes the members and scopes it touched. Batches must arrive in order; inside a batch any
order will do.

The tables and a batch's members are joined by shuffle: they grow with the input, however small their files are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.constants import HIGHEST_PROFIT_KEY
from turnstile.functions.order import ARRIVAL
from turnstile.operators import highwater as H
from turnstile.operators.folds import fold
from turnstile.session import materialise, scratch_scope, side_by_side
from turnstile.sinks.tables import UpsertTable


def high_water_step(name: str, sales: DataFrame, expenses: DataFrame | None, path: str,
                    sink: Callable[[DataFrame, int], None]) -> tuple[DataFrame, Callable[[DataFrame, int], None]]:
    """The stream to run for result `name`, and what to do with each of its micro-batches."""
    profit = name == "highest_profit_event"
    stream = H.profit_contest(sales, expenses) if profit else H.city_contest(sales)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        totals, bests, names = (UpsertTable(spark, f"{path}/{t}", *keys) for t, keys in (
            ("totals", stream.by), ("bests", ["scope"]), ("names", ["member"])))
        with scratch_scope(spark):
            contest = replace(stream, entries=materialise(batch, "entries"))  # decoded once, read several times
            known = bests.read(before=batch_id, touching=contest.entries if contest.scope else None)
            old = totals.read(before=batch_id, touching=contest.entries)
            if old is not None:
                old = _touched(contest, old, contest.matches("t"))
            if known is not None and contest.scope:
                known = _touched(contest, known, "e.scope <=> t.scope")
            cells = H.shortlist(contest, H.with_carry(H.fold_cells(contest), old), keep_last=True)
            begun = known is not None and (not profit or not known.isEmpty())

            def best_here() -> DataFrame:
                best = H.best_of(contest, cells, known)
                return H.in_doubles(bests.merge(best if known is None else _changed(contest, best, known), batch_id, order=None))

            def name_new() -> None:
                kept = names.read(before=batch_id, touching=contest.entries)
                names.merge(_names(contest.entries, kept), batch_id, order=None)

            jobs = [best_here, lambda: totals.merge(H.carry(contest, cells), batch_id, order=None)]
            if profit:
                jobs += [name_new] if begun else [name_new, lambda: _first_profit(contest, old)]
            changed, _, *more = side_by_side(spark, *jobs)
            if profit:
                best, first = (_highest(changed, H.in_doubles(known)), None) if begun else (_highest(changed), more[1])
                shown = best.select("member") if first is None else best.select("member").union(first.select("member"))
                rows = _profit_rows(best, names.read(before=batch_id + 1, touching=shown), first, cells)
            else:
                rows = changed.selectExpr("scope as key", "scope as id", "member as eventName", "value", "pos")
            sink(rows, batch_id)

    return stream.entries, step


def _touched(contest: H.Contest, table: DataFrame, same: str) -> DataFrame:
    """The rows of a table kept so far that entries of this batch belong to."""
    by = ", ".join(contest.by)
    return table.sparkSession.sql(f"select /*+ merge(e) */ t.* from {{table}} t left semi join (select distinct {by} from {{entries}}) e on {same}",
                                  table=table, entries=contest.entries)


def _changed(contest: H.Contest, best: DataFrame, known: DataFrame) -> DataFrame:
    """Scopes whose best was reached in this batch."""
    many = "/*+ merge(k) */" if contest.scope else ""  # as many as there are scopes
    return best.sparkSession.sql(f"""select {many} b.* from {{best}} b left anti join {{known}} k
                                     on b.scope <=> k.scope and b.pos = k.pos""", best=best, known=known)


def _names(batch: DataFrame, old: DataFrame | None) -> DataFrame:
    """The (id, name) of each event that has its first sale ever in this batch."""
    first = {"first": ("min", ARRIVAL)}
    new = fold(batch.where("is_sale"), "member", first, "first").select("member", "id", "name")
    return new if old is None else new.join(old.select("member").hint("merge"), "member", "left_anti")


def _highest(changed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The one best row."""
    return (changed if known is None else changed.union(known.select(changed.columns))).orderBy(F.desc("value"), "pos").limit(1)


def _profit_rows(best: DataFrame, names: DataFrame, first: DataFrame | None, cells: DataFrame) -> DataFrame:
    """Updates of the highest profit. The very first one passes under its event's own id, later ones under the constant id.

    A batch with any profit shows the best so far, also if it is not a new one. The first update gets the arrival before its own: the
    batch's best may have the same, and comes after it.
    """
    run = best.sparkSession.sql
    shown = f"""select b.scope as key, '{HIGHEST_PROFIT_KEY}' as id, n.name as eventName, b.value, b.pos
                from {{best}} b join {{names}} n on b.member = n.member
                where exists (select 1 from {{cells}} where live)"""
    if first is None:
        return run(shown, best=best, names=names, cells=cells)
    return run(f"""
        select '{HIGHEST_PROFIT_KEY}' as key, n.id, n.name as eventName, f.value, cast(f.start - 1 as decimal(38,0)) as pos
        from {{first}} f join {{names}} n on f.member = n.member
        union all {shown} and exists (select 1 from {{first}} where more)""", first=first, best=best, names=names, cells=cells)


def _first_profit(contest: H.Contest, old: DataFrame | None) -> DataFrame:
    """`member, start, more, value` of the first profit that any event shows: one row, or none yet."""
    spark = contest.entries.sparkSession
    carried = (old if old is not None else spark.createDataFrame(
        [], "member string, total decimal(38,6), first_sale decimal(38,0), first_expense decimal(38,0)"))
    return materialise(spark.sql(f"""
        with entries as (select *, {ARRIVAL} as pos from {{entries}}),
        sides as (
          select member, min(first_sale) as sale, min(first_expense) as expense, max(last) as last from (
            select member, min(if(is_sale, pos, null)) as first_sale, min(if(is_sale, null, pos)) as first_expense, max(pos) as last
            from entries group by member
            union all select member, first_sale, first_expense, null from {{carried}}) group by member),
        earliest as (
          select min_by(member, greatest(sale, expense)) as member, min(greatest(sale, expense)) as start,
                 count(*) > 1 or max(last > greatest(sale, expense)) as more
          from sides where sale is not null and expense is not null group by '{HIGHEST_PROFIT_KEY}')
        select f.member, f.start, any_value(f.more) as more, cast(sum(e.delta) as double) as value from (
          select member, pos, delta from entries union all select member, cast(0 as decimal(38,0)), total from {{carried}}) e
        join (select /*+ broadcast */ * from earliest) f on e.member = f.member and e.pos <= f.start group by f.member, f.start""",
                                 entries=contest.entries, carried=carried), "first")
