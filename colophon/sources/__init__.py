"""Readers with explicit schemas and writers for the engine's files."""
