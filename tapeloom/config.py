"""Fixed values of the method, in one place."""

# History lengths in bars.
FULL_BARS, YOUNG_BARS, SCAN_BARS, STALE_SESSIONS = 260, 126, 200, 3
# Momentum legs as weight and bars back.
LEGS = [(0.4, 63), (0.2, 126), (0.2, 189), (0.2, 252)]
# Per market the price floor, 20-day value floor, daily range floor in per cent, lot, slippage and fee per side.
MARKETS = {"MY": {"price": 0.5, "value": 2_000_000.0, "adr": 1.5, "lot": 100, "slip": 0.0030, "fee": 0.0018}, "US": {"price": 10.0, "value": 5_000_000.0, "adr": 2.5, "lot": 1, "slip": 0.0010, "fee": 0.0005}}
# Rank floor and caps of the board's buckets, and the buy window around the pivot.
RANK_FLOOR, CAPS, BUY_BELOW, BUY_ABOVE = 55, {"swing": 20, "position": 30, "watchlist": 20, "forming": 15}, 0.05, 0.02
# Replay defaults.
RISK, STOP, SLOTS, MAX_POSITION, MAX_HOLD, START = 0.01, 0.08, 8, 0.25, 40, 100_000.0
# Receipts, factor buckets, weekly view.
TRIGGER_WINDOW, EVAL_WINDOW, FORWARD, BUCKETS, FACTOR_ROWS, STAGE_WEEKS, SLOPE_WEEKS = 15, 60, 20, 5, 30, 30, 10
