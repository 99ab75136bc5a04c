"""Composable DataFrame transforms for conversational application data."""
