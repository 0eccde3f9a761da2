"""functions of meetspark."""
