"""End-to-end analyses, and the adapter from the star-schema tables."""
