"""Registered queries: importing the package fills catalog.QUERIES and catalog.SQL."""

from . import catalog, folds, ledgers, operations, research, sets, signals, streams  # noqa: F401
