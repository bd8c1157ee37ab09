"""quire: document-archive analytics expressed as Spark DataFrame jobs."""
