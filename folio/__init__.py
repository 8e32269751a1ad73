"""folio: document knowledge-base jobs on Spark tables."""

__version__ = "0.1.0"
