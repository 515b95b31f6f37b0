"""Registered queries: operators applied to the tables, with the SQL they are held against."""
