"""Column functions: every one returns a Spark expression that stays inside code generation."""
