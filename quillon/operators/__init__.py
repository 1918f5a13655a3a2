"""DataFrame-to-DataFrame operators over versioned records."""
