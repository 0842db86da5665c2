"""Whole plans: the layers and the hotspot view."""
