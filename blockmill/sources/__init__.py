"""Readers that give the engine's input DataFrames."""
