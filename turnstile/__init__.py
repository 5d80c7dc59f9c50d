"""Ticket-revenue analytics on Spark: one DataFrame function per result, batch or streaming."""
