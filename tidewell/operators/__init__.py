"""Operators by subject; importing this registers all of them."""

from tidewell.sources import relations  # isort: skip  the operators need these
from tidewell.operators import allocation, backtest, calendar, dayplan, drift, flows, guards, indicators, judgement, ledger, misc, research, risk, scores

__all__ = ["allocation", "backtest", "calendar", "dayplan", "drift", "flows", "guards", "indicators", "judgement", "ledger", "misc", "relations", "research", "risk", "scores"]
