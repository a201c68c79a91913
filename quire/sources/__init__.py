"""Raw files in, tables and texts out."""
