"""Matrix readers, result writers and result lookup."""
