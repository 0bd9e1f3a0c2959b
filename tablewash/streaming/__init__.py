"""Cleaning streams with steps that need no order and no second look at the data."""
