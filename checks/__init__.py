"""Checking side of the repository: derived inputs, registered queries and their SQL twins."""
