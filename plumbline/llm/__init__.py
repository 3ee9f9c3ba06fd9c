"""Operators for preparing training data from web text; nothing else in the library imports this subpackage."""
