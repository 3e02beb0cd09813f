"""Entity master data and analytics operators as DataFrame transformations."""
