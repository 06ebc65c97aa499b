"""Readers, and views that give the test tables the shape of annotation data."""
