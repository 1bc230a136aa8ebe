"""Part of strataflow."""
