"""Part of the page analytics engine."""
