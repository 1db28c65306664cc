"""functions of foliant."""
