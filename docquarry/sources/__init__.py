"""Readers and writers: patent XML, the tables of a data directory, stop words, the stored index."""
