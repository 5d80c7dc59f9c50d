"""The hand-computed case: nine records in one total order, all on 2026-01-01 UTC."""

from datetime import datetime, timezone

from turnstile.schemas import EXPENSES, SALES


def at(clock: str, day: int = 1) -> datetime:
    h, m, s = map(int, clock.split(":"))
    return datetime(2026, 1, day, h, m, s, tzinfo=timezone.utc)


SALE_ROWS = [
    ("E1", at("00:00:10"), 1, "S1", "E1", "Tech", "Aveiro", "c", "NORMAL", 40.0, 3),
    ("E2", at("00:00:40"), 3, "S3", "E2", "Rock", "Porto", "c", "VIP", 99.0, 4),
    ("E1", at("00:01:20"), 5, "S5", "E1", "Tech (renamed)", "Lisboa", "c", "STUDENT", 28.0, 5),
    ("E3", at("00:02:05"), 6, "S6", "E3", "Football", "Lisboa", "c", "NORMAL", 30.0, 3),
    (None, at("00:02:30"), 8, "S8", "E1", "Tech", "Braga", "c", "NORMAL", 40.0, 3),
]
EXPENSE_ROWS = [
    ("E1", at("00:00:20"), 2, "X2", "E1", "Tech", "venue", 100.0),
    ("E2", at("00:00:50"), 4, "X4", "E2", "Rock", "venue", 60.0),
    ("E2", at("00:02:10"), 7, "X7", "E2", "Rock", "staff", 300.0),
    ("E4", at("00:03:00"), 9, "X9", "E4", "Comedy", "venue", 70.0),
]


def frames(spark, sales=SALE_ROWS, expenses=EXPENSE_ROWS):
    return spark.createDataFrame(sales, SALES), spark.createDataFrame(expenses, EXPENSES)


# result -> {(id, eventName): value}, or {clock minute: value} for windows
EXPECTED = {
    "revenue_per_event": {("E1", "Tech"): 260, ("E2", "Rock"): 396, ("E3", "Football"): 90},
    "expenses_per_event": {("E1", "Tech"): 100, ("E2", "Rock"): 360, ("E4", "Comedy"): 70},
    "profit_per_event": {("E1", "Tech"): 160, ("E2", "Rock"): 36},
    "total_revenue": {("TOTAL_REVENUE", "Total Revenue"): 866},
    "total_expenses": {("TOTAL_EXPENSES", "Total Expenses"): 530},
    "total_profit": {("TOTAL_PROFIT", "Total Profit"): 336},
    "average_sale_per_event": {"E1": 130, "E2": 396, "E3": 90},
    "average_sale_all_events": {("AVG_ALL_EVENTS", "Average Ticket Sale All Events"): 173.2},
    "highest_profit_event": {("HIGHEST_PROFIT_EVENT", "Rock"): 336},
    "revenue_per_minute": {0: 516, 1: 140, 2: 210},
    "expenses_per_minute": {0: 160, 2: 300, 3: 70},
    "profit_per_minute": {0: 356, 2: -90},
    "city_highest_sales_per_event": {("E1", "Lisboa"): 140, ("E2", "Porto"): 396, ("E3", "Lisboa"): 90},
}


def shape(name, rows):
    """Collected result rows in the form of EXPECTED."""
    if name.endswith("_per_minute"):
        return {int((int(r.key.rsplit("_", 1)[1]) // 60_000) % 60): r.value for r in rows}
    if name == "average_sale_per_event":
        return {r.key: r.value for r in rows}
    return {(r.id, r.eventName): r.value for r in rows}
