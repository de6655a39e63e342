"""Configuration, planning and running of checks."""
