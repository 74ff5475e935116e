"""CSV loaders and binary block formats."""
