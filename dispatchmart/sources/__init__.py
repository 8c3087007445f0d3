"""Readers, loads and the audit trail."""
