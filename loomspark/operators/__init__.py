"""Relational operators over corpora and logs."""
