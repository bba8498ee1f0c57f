"""Checklist-coverage analytics on Spark: which listed species were found, are dormant, or are missing."""
