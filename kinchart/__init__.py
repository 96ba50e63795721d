"""kinchart: personal and family health-record analytics as Spark jobs."""

__version__ = "0.1.0"
