"""Writers: per-channel layout, run results, exports with metadata header."""
