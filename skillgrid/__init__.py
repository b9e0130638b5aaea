"""Labour-market analytics as DataFrame jobs."""

__version__ = "0.1.0"
