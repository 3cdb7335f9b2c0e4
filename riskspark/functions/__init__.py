"""Column expressions. All are built-in functions, so they stay JVM-side and inside codegen."""
