"""Plan helpers: sessions, shared storage and lineage cuts."""
