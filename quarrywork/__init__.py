"""quarrywork: corpus curation, retrieval and citation operators as Spark DataFrame plans."""

__version__ = "0.1.0"
