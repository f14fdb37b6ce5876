"""strandloom: graph-augmented retrieval analytics as PySpark DataFrame operators."""
