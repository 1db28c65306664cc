"""sources of foliant."""
