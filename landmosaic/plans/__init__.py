"""Registered plans: each query over the given tables, with its SQL oracle."""
