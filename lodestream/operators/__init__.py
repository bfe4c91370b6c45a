"""Operators on events and deliveries, each a plan over DataFrames."""
