"""Reports and extracts, composed of the operators."""
