"""Part of strataspark."""
