"""DataFrame operators: URL and time functions live in functions/, views in plans/."""
