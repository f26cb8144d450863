"""Whole jobs: governing, preparing, packing."""
