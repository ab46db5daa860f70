"""Query tools and reports composed of operators."""
