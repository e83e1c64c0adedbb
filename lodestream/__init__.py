"""Content retrieval and analytics as composable DataFrame programs."""
