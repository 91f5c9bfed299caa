"""plans of quirelight."""
