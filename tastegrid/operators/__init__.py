"""DataFrame operators: no jobs, no caching, no session handling."""
