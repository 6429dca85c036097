"""Operators that move rows: windows, joins, encoding, sampling, aggregates, clustering."""
