"""Helpers that shape plans: shared tables that cut lineage."""
