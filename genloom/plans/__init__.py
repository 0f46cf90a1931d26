"""Whole flows (genome stages) and the registered queries."""
