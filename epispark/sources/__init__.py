"""Readers and writers. Writers run a job; readers stay lazy."""
