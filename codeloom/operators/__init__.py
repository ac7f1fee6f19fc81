"""Operators over files, texts, symbols, projects, intervals, graphs and events."""
