"""Reading snapshots and registers, landing new files, and publishing."""
