"""Quillstream: transcript analytics as DataFrame and Column transformations."""
