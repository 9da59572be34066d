"""Readers: star-schema views, catalog files, chart files, landed pages."""
