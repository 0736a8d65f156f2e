"""Registered queries and the test relations that they run on."""
