"""Column-level building blocks: canonical numeric/date forms and bucket ladders."""
