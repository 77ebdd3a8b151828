"""Typed readers, filters and writers."""
