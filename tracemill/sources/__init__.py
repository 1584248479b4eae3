"""Readers that turn files and documents into typed DataFrames."""
