"""Detection, redaction and clean-up of personal data in large text tables, as Spark plans."""

__version__ = "0.1.0"
