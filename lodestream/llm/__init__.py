"""Training-data operators; each module holds one operator and works on its own."""
