"""Where results go: text and JSON lines, metrics, atomic snapshots, reports and published books."""
