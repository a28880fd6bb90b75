"""Operators over DataFrames; none is tied to one data set."""
