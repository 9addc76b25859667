"""DataFrame operators: filters, joins, ranking, binning, scores, matching."""
