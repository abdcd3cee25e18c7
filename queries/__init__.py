"""Registered queries, one module per operator family, each beside its SQL equivalent."""
