"""Scoring of growing logs."""
