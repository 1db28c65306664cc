"""streaming of foliant."""
