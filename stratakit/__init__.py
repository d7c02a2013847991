"""Signature-based taxonomic profiling and corpus preparation as DataFrame plans on Spark."""
