"""Whole answers: batch pipeline and composite queries."""
