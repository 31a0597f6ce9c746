"""Registered queries, each beside its DuckDB SQL."""
