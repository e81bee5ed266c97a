"""Long-form web text on Spark: pages to chapters to books, documents to chunks to requests."""

from inkloom.config import DEFAULT, DOCUMENTED, ExtractConfig
from inkloom.session import build_session

__all__ = ["DEFAULT", "DOCUMENTED", "ExtractConfig", "build_session"]
