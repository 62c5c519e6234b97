"""Whole queries: the proxies on the driver's tables, with their SQL."""
