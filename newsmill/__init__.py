"""News-feed analytics and corpus preparation as Spark jobs."""
