"""Stateful keyed operators and their closed forms."""
