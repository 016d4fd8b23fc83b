"""DataFrame-level operators: dedup, reshape, joins, quantiles, NTILE, integrity, load."""
