"""Registered queries: input builders, Spark plans and the SQL that checks them."""
