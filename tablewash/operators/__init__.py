"""Cleaning, profiling and scoring operators over DataFrames."""
