"""Research-integrity screening over large corpora as PySpark DataFrame operators."""

__version__ = "0.1.0"
