"""DataFrame operators: upserts, joins, aggregates, reference checks, packed fields."""
