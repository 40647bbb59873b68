"""gridloom: multi-sample interval and track analytics as Spark DataFrame jobs."""
