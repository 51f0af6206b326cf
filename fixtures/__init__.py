"""Documents rendered from the test tables, and the registered queries on them with their SQL."""
