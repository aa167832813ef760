"""Column functions: URLs, text, citations, dates. All stay in the JVM unless they say otherwise."""
