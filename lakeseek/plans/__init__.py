"""Plan assembly: configuration, registries, steps, facade."""
