"""Every operator run over the tables on disk, with the same question in SQL."""

from __future__ import annotations

import importlib

from parley.plans.catalog.base import ORACLES, QUERIES

for _part in ("rollups", "scalars", "threads", "promises", "judgements", "hygiene", "ingest", "audits", "streams"):
    importlib.import_module(f"parley.plans.catalog.{_part}")

__all__ = ["ORACLES", "QUERIES"]
