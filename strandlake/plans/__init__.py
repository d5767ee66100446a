"""The registered queries: importing the package fills catalogue.QUERIES and catalogue.ORACLES."""

from . import call_queries, catalogue, event_queries, mapping_queries, pair_queries, pileup_queries, population_queries, record_queries

__all__ = ["call_queries", "catalogue", "event_queries", "mapping_queries", "pair_queries", "pileup_queries", "population_queries", "record_queries"]
