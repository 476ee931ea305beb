"""Registered queries over the provided tables, each with its SQL check where one exists."""
