"""Queries registered with the driver, and the SQL they are compared with."""
