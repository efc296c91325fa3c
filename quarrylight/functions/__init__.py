"""See the package docstring of quarrylight."""
