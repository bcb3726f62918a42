"""Session settings and the shared folder for cut lineage."""
