"""caselens: startup-project cases, their hypergraphs and rules as Spark jobs."""
