"""Queries over whole tables, with SQL that gives the same rows, and run settings."""
