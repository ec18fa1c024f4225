"""Column expressions. Everything here stays on the JVM side; there is no Python UDF."""
