"""Readers and writers: role views, JSON Lines, JSON lists/maps, CSV."""
