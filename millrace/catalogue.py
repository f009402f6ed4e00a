"""Registered queries of the commerce operators, and their DuckDB SQL."""

from __future__ import annotations

from .plans import changes, envelopes, trade, traffic

QUERIES = {**traffic.QUERIES, **trade.QUERIES, **changes.QUERIES, **envelopes.QUERIES}
SQL = {**traffic.SQL, **trade.SQL, **changes.SQL, **envelopes.SQL}
