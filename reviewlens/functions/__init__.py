"""Column-level functions: everything here stays an expression Catalyst can plan."""
