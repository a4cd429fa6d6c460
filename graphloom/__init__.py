"""A property-graph analytics engine on Spark: tables of nodes, typed triples, vectors, texts and metrics."""
