"""Registered queries on the test tables, each beside its SQL for an independent engine."""
