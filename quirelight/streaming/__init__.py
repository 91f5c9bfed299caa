"""streaming of quirelight."""
