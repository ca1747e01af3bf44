"""Column functions; all stay in the JVM."""
