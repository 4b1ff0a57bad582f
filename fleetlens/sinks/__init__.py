"""Writers for findings, reports, histories and snapshots."""
