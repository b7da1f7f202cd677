"""Assembled plans: the operators bound to tables, and the registry of runnable queries."""
