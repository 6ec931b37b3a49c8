"""See the package README section on functions."""
