"""DataFrame operators: timeline, joins, graphs, trees, retrieval, activity, labels."""
