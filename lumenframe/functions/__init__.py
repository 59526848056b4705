"""See the README for what this subpackage holds."""
