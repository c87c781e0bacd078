"""Operators for preparing training data from texts and records; nothing else in the library depends on them."""
