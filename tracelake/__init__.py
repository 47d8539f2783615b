"""Tracelake: provenance analytics for code history, expressed as Spark DataFrame plans."""
