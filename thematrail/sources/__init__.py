"""Tables read from files, and reports written to them."""

from .delimited import canonical, load_csv
from .reports import write_report
from .stored import cached, load_pages

__all__ = ["cached", "canonical", "load_csv", "load_pages", "write_report"]
