"""Reports, summary views, listings and load jobs built from the operators."""
