"""Query languages compiled to DataFrame plans, and the registry of queries."""
