"""Column functions: all are built-in expressions and stay inside code generation."""
