"""operators of quirelight."""
