"""threadlab: labelled discussion threads as Spark DataFrame jobs."""
