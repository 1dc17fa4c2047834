"""Column expressions. All of them run in the JVM."""
