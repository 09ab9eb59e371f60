"""Operators for large text and record collections; nothing outside imports this."""
