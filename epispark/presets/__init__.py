"""Ready-made configurations: pure data, no logic."""
