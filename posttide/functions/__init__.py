"""Column expressions: everything here stays inside the JVM except the t distribution."""
