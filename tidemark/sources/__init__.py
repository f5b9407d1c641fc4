"""Reading and writing change logs."""
