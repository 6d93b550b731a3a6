"""Planners that walk small tables in order."""
