"""Plans of the text-admission engine."""
