"""A Spark-native engine for document analytics: files become pages, blocks, sections, chunks, entities and
inferred schemas, all as DataFrame, SQL and Structured Streaming operations over whole corpora."""

__version__ = "0.1.0"
