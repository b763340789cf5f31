"""Small sources with and without each finding: the fixtures of the rule queries and tests."""
