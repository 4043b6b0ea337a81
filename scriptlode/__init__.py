"""SQL script corpora as data: catalog, query facts and corpus statistics on Spark."""

__version__ = "0.1.0"
