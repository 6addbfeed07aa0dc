"""Registered queries, by area; importing `all_queries` registers them."""
