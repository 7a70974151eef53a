"""Message-archive analytics on Spark: ingest, archive, plan, stream and report."""
