"""codelode: retrieval and code-graph analytics over code repositories as Spark DataFrame plans."""

__version__ = "0.1.0"
