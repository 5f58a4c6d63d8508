"""Registered queries: name -> (query, the same in SQL or None)."""
