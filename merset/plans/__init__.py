"""Whole selection plans, checks and reports."""
