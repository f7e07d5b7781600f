"""Query text to algebra to DataFrame plans."""
