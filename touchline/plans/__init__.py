"""Runnable queries, grouped by what they read; importing this package registers them all."""

from touchline.plans import boards, events, files, frames, statistics, streams, timeseries, tracks  # noqa: F401
from touchline.plans.registry import ORACLES, QUERIES  # noqa: F401

ORACLES["summary_sentences"] = boards.summary_sql(ORACLES)
