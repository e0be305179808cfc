"""User-defined functions and registries."""
