"""What binary artifacts say in text: channels without provenance, severity or verdict."""
