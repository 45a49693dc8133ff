"""The driver's tables seen as ratings, items, candidates, events, requests and profiles, and the checked queries."""
