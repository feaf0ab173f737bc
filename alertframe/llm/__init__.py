"""Training-data pipeline operators (a leaf subpackage: nothing else in the library imports it)."""
