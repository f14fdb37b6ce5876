"""Training-data operators (numbered 1 to 10). Nothing else in the library imports this subpackage."""
