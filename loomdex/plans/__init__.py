"""Plan-level helpers: lineage cuts, table access, plan inspection."""
