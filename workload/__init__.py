"""Registered queries: library operators on the shared test tables, each with its plain-SQL twin."""

from workload import clean_queries, hotspot_queries, model_queries, package_queries, scene_queries, spatial_queries

QUERY_MODULES = [clean_queries, scene_queries, spatial_queries, hotspot_queries, package_queries, model_queries]
