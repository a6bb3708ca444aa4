"""DataFrame-to-DataFrame operators; column names are always arguments."""
