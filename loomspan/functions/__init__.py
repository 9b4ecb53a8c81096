"""Column expressions: numbers, text, dates and catalogues.  All of them stay inside the JVM."""
