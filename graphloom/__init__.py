"""graphloom: knowledge-graph and document analytics as Spark DataFrame jobs."""
