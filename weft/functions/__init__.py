"""Weight expressions, presets and machine generators."""
