"""Where choice data comes from and where results go."""
