"""Readers that turn raw tables and landing zones into the engine's tables."""
