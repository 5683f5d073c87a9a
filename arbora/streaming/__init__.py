"""Nothing here: the query class this engine plans is over bounded tables, and has no streaming operators."""
