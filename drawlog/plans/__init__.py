"""Registered queries over the test tables and their check SQL."""
