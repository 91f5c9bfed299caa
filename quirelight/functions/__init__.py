"""functions of quirelight."""
