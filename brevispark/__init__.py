"""Text-measurement analytics on Spark: sampling, prompt building, alignment and statistics as DataFrame operators."""
