"""Column functions: text, token arrays and scalars.  All are built-in expressions, so plans stay in the JVM."""
