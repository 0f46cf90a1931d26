"""Comparative-genomics and interval analytics as DataFrame operators."""
