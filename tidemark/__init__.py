"""tidemark: config-driven table loads on Spark."""

from tidemark.config import Mapping, PipelineConfig
from tidemark.session import build_session

__all__ = ["Mapping", "PipelineConfig", "build_session"]
