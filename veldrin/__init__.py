"""Document, retrieval and conversation analytics as Spark plans."""

__version__ = "0.1.0"
