"""Operators of a training-corpus pipeline over the library's event and article records."""
