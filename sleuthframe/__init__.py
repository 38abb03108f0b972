"""Code analytics on Spark: relations from source trees and version history, checks as DataFrame plans."""

__version__ = "0.2.0"
