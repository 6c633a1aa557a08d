"""Registry of the conversation queries and their DuckDB equivalents; importing it loads all of them."""

from __future__ import annotations

from parley.plans import analytics, detection, flows, intake, lifecycle, live, nested, relational, signals, streams, texts  # noqa: F401
from parley.plans.registry import ORACLES, QUERIES  # noqa: F401
