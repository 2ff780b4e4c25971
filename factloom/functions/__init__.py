"""Part of factloom."""
