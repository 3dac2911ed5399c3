"""Column functions: every one is a native expression and adds no shuffle."""
