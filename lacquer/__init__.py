"""lacquer: a PySpark engine for messy, hierarchical catalogue metadata."""

__version__ = "0.1.0"
