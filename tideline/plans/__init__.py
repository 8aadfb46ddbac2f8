"""Whole flows over the given tables: the registered queries and their DuckDB SQL."""
