"""Public-notice analytics on Spark: composable DataFrame operators with exact rules."""
