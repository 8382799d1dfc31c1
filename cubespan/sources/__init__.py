"""Where cubes come from and where results go."""
