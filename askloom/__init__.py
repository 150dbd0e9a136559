"""askloom: a PySpark engine for building and analysing question-and-answer corpora."""

__version__ = "0.1.0"
