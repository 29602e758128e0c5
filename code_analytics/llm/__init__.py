"""Training-data operators on text tables. Nothing else in the library imports this subpackage."""
