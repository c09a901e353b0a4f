"""Part of lapwise."""
