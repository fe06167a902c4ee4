"""Registered queries, defect views and cleaning plans."""
