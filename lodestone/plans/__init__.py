"""Query trees: nodes, parser, rewrites and the compiler to Column expressions."""
