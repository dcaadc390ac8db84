"""Record linkage, screening and screening analytics as Spark jobs."""
