"""lodestone: relational, property-graph and full-text analytics on PySpark."""
