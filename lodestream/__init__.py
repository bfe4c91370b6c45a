"""Lodestream: standing subscriptions over event data, and corpus operators, as Spark plans."""
