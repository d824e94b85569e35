"""Column functions: no DataFrame, no shuffle."""
