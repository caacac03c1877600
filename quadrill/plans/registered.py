"""All queries of the library: importing the plan modules registers them."""

from __future__ import annotations

from quadrill.plans import catalog, learning, multihop, phases, reranking, temporal, utilities  # noqa: F401  registers its queries


def queries() -> dict[str, catalog.Query]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLES)
