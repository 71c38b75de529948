"""Operators over DataFrames and models."""
