"""Sources: the files data source and driver tables."""

from .files import FilesDataSource, read_files, register
from .tables import table

__all__ = ["FilesDataSource", "read_files", "register", "table"]
