"""Column-level functions: text analysis, IP keys, string-indexing modes."""
