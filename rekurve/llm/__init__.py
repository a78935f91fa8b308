"""Corpus operators for the notes, files and feature vectors that experiments carry; nothing else in the package imports this folder."""
