"""chronoloom: event and business analytics written as Spark DataFrame jobs."""
