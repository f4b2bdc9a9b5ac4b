"""Column-to-Column functions: text similarity and geometry."""
