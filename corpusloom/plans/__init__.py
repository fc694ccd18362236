"""Named queries over the test tables, their SQL counterparts, and whole commands over views."""
