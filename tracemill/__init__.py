"""Agent-activity analytics on Spark: transcript ETL, an invocation fact table and its marts."""
