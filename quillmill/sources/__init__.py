"""Readers of packages: archives, members, XML nodes."""
