"""Readers: base tables, post files (CSV / text / JSON), catalogs, saved runs."""
