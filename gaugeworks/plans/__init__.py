"""All queries of the library and their oracle SQL, by name."""
