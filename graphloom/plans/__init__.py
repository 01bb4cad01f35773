"""Building blocks of longer jobs: scratch tables."""
