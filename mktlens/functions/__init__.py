"""Column functions: expressions over columns, evaluated in the JVM."""
