"""Batch analytics over customer communications, written for Spark."""

from commlens.settings import Settings

__all__ = ["Settings"]
