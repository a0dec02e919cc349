"""claimloom: reconciliation of document claims, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
