"""graphloom: code-graph analytics and corpus preparation on Apache Spark."""
