"""Readers and writers: position files, archives, ports, tables."""
