"""Data sources: directory trees, repositories, configuration."""
