"""Reading and assembling tables."""
