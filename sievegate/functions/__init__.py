"""Functions of the text-admission engine."""
