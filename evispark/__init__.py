"""Evidence-graph analytics as PySpark DataFrame operators."""
