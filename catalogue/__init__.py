"""Registered queries, the corpora they run on and the SQL they are checked against."""
