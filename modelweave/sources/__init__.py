"""Where models come from."""
