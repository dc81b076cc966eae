"""Feature-layer, retrieval and analytics operators written as Spark DataFrame jobs."""
