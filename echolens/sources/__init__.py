"""Landed payloads, configuration tables and exports."""
