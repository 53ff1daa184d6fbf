"""Rules over files as they arrive."""
