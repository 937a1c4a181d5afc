"""Queries: operators bound to the tables of a data folder, each with its SQL."""
