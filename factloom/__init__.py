"""factloom: call transcripts to cited, versioned facts, as PySpark DataFrame operations."""

__version__ = "0.1.0"
