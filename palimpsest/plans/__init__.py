"""Retrieval plans: a tree of operators compiled to one lazy DataFrame."""
