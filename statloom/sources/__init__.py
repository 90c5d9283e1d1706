"""Table sources and sinks, and the saved-model registry."""
