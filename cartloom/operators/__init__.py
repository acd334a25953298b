"""DataFrame-to-DataFrame operators; query keys always arrive as tables."""
