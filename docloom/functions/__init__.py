"""Column expressions; all JVM-side unless a docstring says otherwise."""
