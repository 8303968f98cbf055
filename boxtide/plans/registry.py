"""All queries of the library and their SQL."""

from __future__ import annotations

from boxtide.plans import detection, judged, more, reports, scans, streams, tables

QUERIES = detection.QUERIES | judged.QUERIES | more.QUERIES | reports.QUERIES | scans.QUERIES | tables.QUERIES | streams.QUERIES
ORACLES = detection.ORACLES | judged.ORACLES | more.ORACLES | reports.ORACLES | scans.ORACLES | tables.ORACLES | streams.ORACLES
