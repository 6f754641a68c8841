"""Reports composed of operators, and the registered queries with their oracle SQL."""
