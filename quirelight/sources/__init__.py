"""sources of quirelight."""
