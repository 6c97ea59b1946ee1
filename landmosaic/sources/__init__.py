"""Readers and writers of point files, records, crosswalks, layers and results."""
