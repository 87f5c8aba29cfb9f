"""casekit: case scoring, customer features and text retrieval as Spark DataFrame operators."""

__version__ = "0.1.0"
