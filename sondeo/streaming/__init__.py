"""The exercise filter and counts over a stream of files."""
