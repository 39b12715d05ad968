"""Whole plans: annotate, convert, finalise, compile, solve, simulate, summarise."""
