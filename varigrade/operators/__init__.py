"""Table operators: columns, joins, aggregates, encoding, coordinates, folds, metrics, models."""
