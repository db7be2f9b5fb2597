"""Column-level building blocks: patterns, masks, rules and key helpers."""
