"""Record contracts, readers, writers and table-derived inputs."""
