"""operators of meetspark."""
