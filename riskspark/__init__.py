"""riskspark: insurance risk and fraud features as Spark DataFrame jobs."""
