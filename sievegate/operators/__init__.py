"""Operators of the text-admission engine."""
