"""Norms and their compilation into Spark plans."""
