"""DataFrame operators: aggregates, lookups, conditional formats, filters, charts, hierarchies, the grid."""
