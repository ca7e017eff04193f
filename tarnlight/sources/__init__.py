"""Reading tables from files."""
