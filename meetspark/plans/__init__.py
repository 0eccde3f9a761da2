"""plans of meetspark."""
