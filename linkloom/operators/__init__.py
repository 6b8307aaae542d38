"""DataFrame operators: sampling, joins, ranking, decisions, metrics."""
