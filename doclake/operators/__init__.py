"""Query operators over DataFrames: search, filters, views, relations, evidence, lifecycle, reconciliation, naming."""
