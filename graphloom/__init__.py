"""graphloom: documents to a deduplicated knowledge graph, as Spark DataFrame transforms."""
