"""Scalar expressions and the helpers that run keyed state over sorted rows."""
