"""Report documents and tables."""
