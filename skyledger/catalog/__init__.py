"""Queries over the driver tables, each beside its DuckDB SQL."""
