"""The subscription language: text to values and back.  Nothing here needs Spark."""

from .expression import parse_expression
from .reader import ParseError
from .subscription import Subscription, canon, fmt, parse, validate

__all__ = ["ParseError", "Subscription", "canon", "fmt", "parse", "parse_expression", "validate"]
