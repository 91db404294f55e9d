"""Per-format conversion plans built on the lift operator."""
