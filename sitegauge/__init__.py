"""Web-site auditing over captured pages with Spark."""

from .plans.audit import audit, check_definitions
from .session import build_session

__all__ = ["audit", "build_session", "check_definitions"]
