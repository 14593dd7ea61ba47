"""Languages, syntax tree and plans."""
