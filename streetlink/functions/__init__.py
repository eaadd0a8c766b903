"""Column functions: cleanup, rendering, keys."""
