"""High-water mark of running totals: the largest value a total ever reached, and when it first did.

Defined per record: each member of a scope has a running total over its entries in arrival order; the answer of the
scope is the largest running total seen, the earliest one on a tie. Sorting all entries would shuffle the whole
input, so the work is cut down first:

1. Fold the entries into cells (member x time slot) with one hash aggregate. A prefix sum over the few cells of a
   member gives the total at the start and end of each.
2. The best cell end is a lower bound of the answer. `start total + rises in the cell` bounds a cell from above;
   cells below the lower bound are dropped. A cell in which nothing falls peaks at its end, so it is solved already.
3. Only the entries of the remaining cells are read again and ordered. They are range-partitioned by (member, arrival)
   and each slice keeps its own total and highest prefix, which combine over the slices. A cell of any size is
   split over many tasks.

A stream applies the same steps to each micro-batch, with the totals so far as one extra cell per member.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from turnstile.constants import HIGHEST_PROFIT_KEY
from turnstile.functions.order import ARRIVAL, arrival_seq, arrival_ts
from turnstile.operators.folds import Measures, aggregates
from turnstile.operators.ledger import ledger, sale_entries
from turnstile.session import materialise

PROFIT_SLOT = 6 * 3_600
CITY_SLOT = 30 * 86_400
BROADCAST_ROWS = 50_000
SCALE = 6  # decimals of the amounts, unless a caller says otherwise: finer ones are rounded, totals of rounded amounts are exact

_CARRIED = -1  # slot of the totals carried over from earlier micro-batches

# What a cell keeps of its entries. `lowest` finds falls.
_CELL: Measures = {
    "n": ("sum", "1"),
    "total": ("sum", "delta"),
    "rise": ("sum", "greatest(delta, 0)"),
    "lowest": ("min", "delta"),
    "highest": ("max", "delta"),
    "last_rise": ("max", "case when delta > 0 then pos end"),
}
_ONE_SIDED: Measures = {"first": ("min", "pos")}
_TWO_SIDED: Measures = {
    "first_sale": ("min", "case when is_sale then pos end"),
    "first_expense": ("min", "case when not is_sale then pos end"),
}


@dataclass(frozen=True)
class Contest:
    """Entries `(member, slot, ts, seq, delta, id, name[, is_sale])` and how they compete.

    `delta` is a decimal, so that totals do not depend on the order of summing, ties are exact, and buffers are of fixed width.

    `scope` is the column within whose values members compete, or None where all compete (the results then carry
    `scope_name`). With `two_sided` a running total counts only once its member has had a sale and an expense.
    """

    entries: DataFrame
    seconds: int
    two_sided: bool = False
    scope: str | None = None
    scope_name: str | None = None

    @property
    def by(self) -> list[str]:
        return [*(["scope"] if self.scope else []), "member"]

    @property
    def firsts(self) -> Measures:
        return _TWO_SIDED if self.two_sided else _ONE_SIDED

    def matches(self, other: str) -> str:
        """SQL condition joining entries `e` to rows of `other`."""
        return " and ".join(f"e.{c} <=> {other}.{c}" for c in self.by)


def exact(amount: str, scale: int, digits: int = 28) -> str:
    return f"cast({amount} as decimal({digits},{scale}))"


def profit_contest(sales: DataFrame, expenses: DataFrame, scale: int = SCALE) -> Contest:
    """Signed amounts of each event; all events compete."""
    entries = ledger(sales, expenses).where("key is not null").selectExpr(
        "key as member", _slot(PROFIT_SLOT), "ts", "seq", "is_sale",
        f"{exact('case when is_sale then amount else -amount end', scale)} as delta", "id", "name")
    return Contest(entries, PROFIT_SLOT, two_sided=True, scope_name=HIGHEST_PROFIT_KEY)


def city_contest(sales: DataFrame, strict: bool = False, scale: int = SCALE) -> Contest:
    """Sales of each (event, city); the cities of an event compete."""
    scope, member = "id", "city"
    if strict:
        member = "concat(coalesce(id, 'null'), '|', coalesce(city, 'null'))"
        scope = f"substring_index({member}, '|', 1)"
    entries = sale_entries(sales, "city").selectExpr(
        f"{scope} as scope", f"{member} as member", _slot(CITY_SLOT), "ts", "seq", f"{exact('amount', scale)} as delta", "id",
        "city as name")
    return Contest(entries, CITY_SLOT, scope="scope")


def high_water(contest: Contest) -> DataFrame:
    """`scope, member, value, pos, named_at` of the highest running total of every scope.

    `named_at` is the arrival of the member's first sale. The peak is found on exact decimals and returned as a double.
    """
    return in_doubles(best_of(contest, shortlist(contest, fold_cells(contest))))


def in_doubles(best: DataFrame) -> DataFrame:
    return best.withColumn("value", best["value"].cast("double"))


def named(contest: Contest, best: DataFrame) -> DataFrame:
    """`best` with the (id, name) of the entry at `named_at`: one entry per row, looked up by its arrival."""
    one_row = contest.scope is None
    small = one_row or best.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return best.sparkSession.sql(f"""
        select {"/*+ broadcast(b) */" if small else ""} b.scope, b.member, b.value, b.pos, e.id, e.name from {{entries}} e join {{best}} b
        on {contest.matches("b")} and e.ts = {arrival_ts("b.named_at")} and e.seq = {arrival_seq("b.named_at")}""",
                                 entries=contest.entries, best=best)


def fold_cells(contest: Contest) -> DataFrame:
    """One row per (scope, member, slot)."""
    by = ", ".join([*contest.by, "slot"])
    return contest.entries.sparkSession.sql(f"""
        select {by}, {aggregates({**_CELL, **contest.firsts})} from (select *, {ARRIVAL} as pos from {{entries}})
        group by {by}""", entries=contest.entries)


def shortlist(contest: Contest, cells: DataFrame, keep_last: bool = False) -> DataFrame:
    """The cells that may hold the peak of their member, each with the total it starts from. Written once.

    A window holds the cells of one member: at most one per slot of calendar time, however many entries there are.
    `keep_last` also keeps each member's last cell, from which `carry` takes its total.
    """
    firsts = list(contest.firsts)
    member = f"partition by {', '.join(contest.by)}"
    whole = ", ".join(f"min({c}) over whole as all_{c}" for c in firsts)
    begun = " and ".join(f"all_{c} is not null" for c in firsts)
    latest = f"greatest({', '.join(f'all_{c}' for c in firsts)})" if len(firsts) > 1 else f"all_{firsts[0]}"
    first = f"least({', '.join(firsts)})" if len(firsts) > 1 else firsts[0]  # of the cell; least() skips NULLs
    scope = "scope" if contest.scope else f"'{contest.scope_name}' as scope"
    kept = [f"all_{c} is not null as has_{c}" for c in firsts] + ["is_last", "base + total as total"]
    return materialise(cells.sparkSession.sql(f"""
        with placed as (
          select *, coalesce(sum(total) over before, 0) as base, slot = max(slot) over whole as is_last, {whole}
          from {{cells}}
          window before as ({member} order by slot rows between unbounded preceding and 1 preceding),
                 whole as ({member} order by slot rows between unbounded preceding and unbounded following)),
        valued as (
          select *, base + total as value, base + if(rise > 0, rise, highest) as ceiling,
                 {first} as first_here, if({begun}, {latest}, null) as start
          from placed),
        lived as (
          select *, slot > {_CARRIED}
                    and coalesce(slot >= unix_micros({arrival_ts('start')}) div {contest.seconds * 1_000_000}, false)
                    as live
          from valued)
        select {scope}, member, slot, base, start, all_{firsts[0]} as named_at, value, ceiling, live,
               if(n = 1, first_here, coalesce(last_rise, first_here)) as pos,
               n = 1 or (lowest >= 0 and first_here >= start) as solved
               {"".join(f", {c}" for c in kept) if keep_last else ""}
        from (select *, max(if(live, value, null)) over ({member}) as own_best from lived)
        where (live and ceiling >= own_best) {"or is_last" if keep_last else ""}""", cells=cells), "cells")


def best_of(contest: Contest, cells: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Best `(scope, member, value, pos, named_at)` per scope, among the shortlisted cells and the `known` bests."""
    run = cells.sparkSession.sql
    live = cells.where("live")
    floors = live.select("scope", "value")
    if known is not None:
        floors = floors.union(known.select("scope", "value"))
    one_floor = "/*+ merge(f) */" if contest.scope else "/*+ broadcast(f) */"  # without scopes there is one, and its key is hot
    contenders = materialise(run(f"""
        select {one_floor} c.scope, member, slot, base, start, named_at, value, pos, solved
        from {{live}} c join (select scope, max(value) as floor from {{floors}} group by scope) f
             on c.scope <=> f.scope and ceiling >= floor""", live=live, floors=floors), "contenders")
    found = contenders.where("solved").select("scope", "member", "value", "pos", "named_at")
    open_cells = contenders.where("not solved")
    open_count = open_cells.limit(BROADCAST_ROWS + 1).count()
    if open_count:
        found = found.union(materialise(_peaks(contest, open_cells, open_count <= BROADCAST_ROWS), "peaks"))
    if known is not None:
        found = found.union(known.select(found.columns))
    return run("""select scope, best.* from (
                    select scope, max_by(struct(member, value, pos, named_at), struct(value, -pos)) as best
                    from {found} group by scope)""", found=found)


def _peaks(contest: Contest, cells: DataFrame, small: bool) -> DataFrame:
    """Highest counted running total of each open cell, entry by entry."""
    run = cells.sparkSession.sql
    # Written before ranging: finding the ranges reads the rows twice, and by now they are few.
    rows = materialise(run(f"""select {"/*+ broadcast(c) */" if small else "/*+ merge(c) */"}
                          c.scope, c.member, c.slot, {ARRIVAL} as pos, e.delta, c.base, c.start, c.named_at
                   from {{entries}} e join {{cells}} c on {contest.matches("c")} and e.slot = c.slot""",
               entries=contest.entries, cells=cells), "open")
    sliced = rows.repartitionByRange("scope", "member", "pos").selectExpr("*", "spark_partition_id() as slice")
    value = "base + peak.local + coalesce(sum(total) over before, 0)"
    # The running totals and their fold share one partitioning, hence one shuffle. Slices then add up like cells did.
    return run(f"""
        with running as (
          select *, sum(delta) over (partition by scope, member, slot, slice order by pos
                                     rows between unbounded preceding and current row) as local
          from {{sliced}}),
        slices as (
          select scope, member, slot, slice, sum(delta) as total, first(base) as base, first(named_at) as named_at,
                 max_by(struct(local, pos), if(pos >= start, struct(local, -pos), null)) as peak
          from running group by scope, member, slot, slice)
        select scope, member, value, pos, named_at from (
          select scope, member, {value} as value, peak.pos, named_at from slices
          window before as (partition by scope, member, slot order by slice
                            rows between unbounded preceding and 1 preceding))
        where pos is not null""", sliced=sliced)


def carry(contest: Contest, cells: DataFrame) -> DataFrame:
    """The totals after `cells`, as one cell per member that precedes those of the next micro-batch.

    Arrival numbers become 0: whatever comes next comes later, even with an older timestamp.
    """
    seen = [f"if(has_{c}, cast(0 as decimal(38,0)), null) as {c}" for c in contest.firsts]
    return cells.where("is_last").selectExpr(*contest.by, "1L as n", "total", *seen)


def with_carry(cells: DataFrame, carried: DataFrame | None) -> DataFrame:
    if carried is None:
        return cells
    return cells.unionByName(carried.selectExpr("*", f"cast({_CARRIED} as bigint) as slot"), allowMissingColumns=True)


def _slot(seconds: int) -> str:
    return f"unix_micros(ts) div {seconds * 1_000_000} as slot"
