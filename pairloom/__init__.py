"""Text-pair data preparation and scoring as Spark DataFrame operators."""
