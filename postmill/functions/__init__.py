"""Column-returning helpers (all evaluated inside the JVM unless stated)."""
