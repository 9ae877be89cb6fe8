"""Readers, and text and JSON forms that other sources arrive in."""
