"""Readers and writers: form and response JSON, revisions, runs, flat tables, CSV."""
