"""Query catalogue and its SQL."""
