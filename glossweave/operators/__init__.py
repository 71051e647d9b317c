"""Operators over token tables (see ``glossweave.annotate``). All are lazy: they take and return DataFrames."""
