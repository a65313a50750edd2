"""Log forensics on Spark: parse collected logs into typed tables and query them."""
