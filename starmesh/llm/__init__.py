"""Training-data operators: dedup, scoring, packing, formatting and archive handling.

Nothing outside this folder imports it; the rest of the library works without it.
"""
