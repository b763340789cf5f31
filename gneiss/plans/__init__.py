"""Whole queries: operators put together over tables."""
