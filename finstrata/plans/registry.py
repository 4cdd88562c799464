"""All queries of the core, by name."""

from finstrata.plans import facts_queries, holdings_queries, incremental_queries, landed_queries, pipeline_queries, reported_queries, series_queries, text_queries

MODULES = [pipeline_queries, holdings_queries, series_queries, text_queries, incremental_queries, facts_queries, landed_queries, reported_queries]


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}
