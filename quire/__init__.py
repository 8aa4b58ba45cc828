"""quire: extraction, cleaning, comparing and merging of document-shaped data on Spark."""

__version__ = "0.1.0"
