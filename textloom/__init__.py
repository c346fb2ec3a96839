"""textloom: corpus analytics and retrieval as DataFrame operations."""

__version__ = "0.1.0"
