"""All registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from listing_lake.plans import jobs, landings, layers, payloads, snapshots

QUERIES = layers.QUERIES | jobs.QUERIES | payloads.QUERIES | snapshots.QUERIES | landings.QUERIES
ORACLES = layers.ORACLES | jobs.ORACLES | payloads.ORACLES | snapshots.ORACLES | landings.ORACLES
