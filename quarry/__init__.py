"""Document analytics on Spark: telemetry, retrieval, coverage, matching, versions and streams as lazy DataFrame operators."""
