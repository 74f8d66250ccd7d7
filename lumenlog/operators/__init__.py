"""Relational and analytic operators over log DataFrames."""
