"""Structured Streaming versions of the two append paths and of the profile rating table."""
