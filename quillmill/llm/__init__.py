"""Training-data operators: each module holds one operator and states its edge cases."""
