"""Document pipelines as Spark jobs: ordered document sequences and token tables."""
