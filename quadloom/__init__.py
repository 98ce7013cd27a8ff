"""SPARQL over Spark: graph queries, updates, rules and shapes as lazy DataFrames."""
