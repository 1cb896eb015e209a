"""Reusable plan shapes: skew-safe ordinals and prefix sums, sync composition."""
