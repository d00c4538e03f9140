"""Index operators: placement, routing, search, deletion."""
