"""Column functions; all run inside the JVM unless they say otherwise."""
