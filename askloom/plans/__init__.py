"""Registered queries: each binds operators to the given tables and states the equal DuckDB SQL."""
