"""All queries over the derived architecture graph, and their SQL."""

from __future__ import annotations

from strataweave.plans import decisions, domains, exchange, graphs, proofs, reports, resolution, resources, reviews, rollups, serving, structure, targets

ENTRIES = rollups.ENTRIES | graphs.ENTRIES | domains.ENTRIES | reviews.ENTRIES | proofs.ENTRIES | reports.ENTRIES | targets.ENTRIES | resolution.ENTRIES | resources.ENTRIES | structure.ENTRIES | serving.ENTRIES | decisions.ENTRIES | exchange.ENTRIES


def queries() -> dict:
    return {name: entry[0] for name, entry in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry[1] for name, entry in ENTRIES.items() if entry[1]}
