"""Sources: connector configs (S1), landed pages (S2/S3), push events (S4),
API page reader (S5), state/run/version tables (S6)."""
