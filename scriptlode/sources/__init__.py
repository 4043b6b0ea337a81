"""Readers of scripts, manifests and run logs."""
