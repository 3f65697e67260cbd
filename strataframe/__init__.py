"""Wide sample tables with profile columns, prepared, scored and checked on Spark."""

from strataframe.schema import ATMOSPHERE, ProfileSchema
from strataframe.session import build_session, scratch_path

__all__ = ["ATMOSPHERE", "ProfileSchema", "build_session", "scratch_path"]
