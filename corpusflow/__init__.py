"""Document collections, chunking, retrieval and conversation history on PySpark."""

__version__ = "0.1.0"
