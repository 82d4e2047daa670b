"""DataFrame-to-DataFrame operators: ordering, joins, ranks, batches, scoring."""
