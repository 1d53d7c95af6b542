"""News-event intelligence and corpus preparation on Spark."""
