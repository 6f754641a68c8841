"""Table operators: lookups, facts, aggregates, statistics, matching, table maintenance and validation."""
