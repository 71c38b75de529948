"""The model's operators on streams."""
