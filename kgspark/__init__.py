"""kgspark: knowledge-graph and ontology analytics as ordinary Spark DataFrame jobs."""
