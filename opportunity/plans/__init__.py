"""Forecast jobs and backtests composed from the operators."""
