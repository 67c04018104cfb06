"""millrace: web-document analytics and information retrieval on Spark DataFrames."""

__version__ = "0.1.0"
