"""All registered queries of the engine itself."""

from __future__ import annotations

from . import checks, flow, ordered, pit, search, texts

QUERIES: dict = {}
SQL: dict[str, str] = {}
for part in (pit, search, texts, flow, checks, ordered):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
