"""Graph, retrieval and trajectory analytics as PySpark DataFrame operators."""
