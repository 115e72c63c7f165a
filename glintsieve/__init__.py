"""glintsieve: source trees as Spark tables, scanned by declarative rules."""

__version__ = "0.1.0"
