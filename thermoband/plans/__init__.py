"""The query catalogue over the test tables, its SQL counterparts, and the whole study."""
