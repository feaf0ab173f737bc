"""alertframe: free-text observation bulletins as Spark tables, and queries over them."""

__version__ = "0.1.0"
