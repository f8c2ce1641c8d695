"""Schemas of the tables that stages hand on."""

BARS = "code string, d date, open double, high double, low double, close double, volume double"
TRADES = (
    "code string, trade_no long, signal_d date, entry_d date, exit_d date, entry_px double, exit_px double, "
    "reason string, bars_held long, ret double"
)
EQUITY = "code string, d date, weight double, equity double"
LABELS = "code string, d date, label string"
