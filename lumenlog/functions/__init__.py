"""Column functions over messages, tokens and templates; all stay in the JVM."""
