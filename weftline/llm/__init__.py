"""Operators for training data and model text; nothing outside imports them."""
