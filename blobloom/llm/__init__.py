"""Training-data operators: mixing, decontamination, scoring, dedup, search, sharding.

Every operator takes DataFrames and returns DataFrames. ``queries`` holds the
thin contract queries, ``oracles`` their DuckDB SQL.
"""
