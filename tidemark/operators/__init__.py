"""Operators over bars, signals, ledgers and operational tables."""
