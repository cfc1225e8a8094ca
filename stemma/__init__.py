"""stemma: code-graph analytics expressed as PySpark DataFrame plans."""
