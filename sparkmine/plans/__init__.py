"""The query catalogue: each plan with its SQL twin."""
