"""operators of foliant."""
