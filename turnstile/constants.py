"""Fixed values of the data contract: labels, keys and rates that results must carry verbatim."""

# --- Fixed values -------------------------------------------------------------------------------
# Record key shared by every all-events result.
TOTAL_KEY = "TOTAL"

# (id, eventName) of the results that carry a constant label.
TOTAL_REVENUE = ("TOTAL_REVENUE", "Total Revenue")
TOTAL_EXPENSES = ("TOTAL_EXPENSES", "Total Expenses")
TOTAL_PROFIT = ("TOTAL_PROFIT", "Total Profit")
REVENUE_WINDOWED = ("TOTAL_REVENUE_WINDOWED", "Total Revenue Windowed")
EXPENSES_WINDOWED = ("TOTAL_EXPENSES_WINDOWED", "Total Expenses Windowed")
PROFIT_WINDOWED = ("TOTAL_PROFIT_WINDOWED", "Total Profit Windowed")
AVERAGE_PER_EVENT = ("AVG_PER_EVENT", "Average Ticket Sale Per Event")
AVERAGE_ALL_EVENTS = ("AVG_ALL_EVENTS", "Average Ticket Sale All Events")
HIGHEST_PROFIT_KEY = "HIGHEST_PROFIT_EVENT"

# Ticket price = base price x rate of the ticket type; every other type has rate 1.0.
TICKET_RATES = {"VIP": 1.8, "STUDENT": 0.7}

# Tumbling window of the per-minute results, and how late a record may be (24 hours less one window).
WINDOW = "1 minute"
LATENESS = "23 hours 59 minutes"

# Column limits of the catalog tables.
EVENT_LIMITS = {"event_id": 20, "event_name": 150, "city": 100, "category": 100}
CITY_NAME_LIMIT = 100
# --- End of fixed values ------------------------------------------------------------------------

# Money is compared and reported at this many decimals (a two-decimal price x 1.8 or 0.7 has three).
MONEY_SCALE = 3
