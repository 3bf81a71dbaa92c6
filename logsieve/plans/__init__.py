"""Named queries, their SQL twins and the end-to-end flows."""
