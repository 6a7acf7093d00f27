"""From a specification and a principal to a DataFrame."""
