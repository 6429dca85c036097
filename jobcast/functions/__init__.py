"""Column-level functions and row filters; every one stays inside generated JVM code."""
