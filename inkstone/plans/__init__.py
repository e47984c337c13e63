"""Session settings, staging of intermediate tables, composed plans."""
