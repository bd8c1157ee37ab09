"""Readers of registers, manifests and landed payloads; table maintenance."""
