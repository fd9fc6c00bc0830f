"""The operators that depend on order or state, over streams."""
