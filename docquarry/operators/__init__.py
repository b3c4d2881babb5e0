"""DataFrame operators: index build, matching, ranking, references, nested records."""
