"""Reading logger files and tidy tables, and the mapping of the test tables."""
