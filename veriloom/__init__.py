"""Veriloom: execution-evidence analytics expressed as Spark DataFrame jobs."""
