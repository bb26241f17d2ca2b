"""The operators bound to the driver's tables: one query per operator."""
