"""Where operations come from and where records are kept."""
