"""quire: gathering landed web pages into ordered, nested collections on Spark."""

__version__ = "0.1.0"
