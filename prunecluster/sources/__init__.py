"""Reading points and writing results."""
