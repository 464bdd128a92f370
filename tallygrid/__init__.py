"""Table profiling and SQL exploration on Spark."""

from tallygrid.session import build_session
from tallygrid.workbench import Workbench

__all__ = ["Workbench", "build_session"]
