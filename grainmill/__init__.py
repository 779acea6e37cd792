"""grainmill: a PySpark-native engine for preparing training data."""

from grainmill.log import get_log_level, get_logger, reset_log_level, reset_logger, set_log_level, set_logger
from grainmill.plans.cache import CacheConfig, CacheEntryInfo, clear_cache, list_cache_entries
from grainmill.plans.context import DataLoadMesh, RuntimeContext
from grainmill.plans.dataset import Consumer, Dataset, FingerprintProvider
from grainmill.plans.identity import ResumeStateError, UnsupportedResume
from grainmill.streaming.loader import Loader

#: The loader under the name that multi-process loaders go by.
TorchLoader = Loader

__version__ = "0.1.0"
__all__ = [
    "CacheConfig", "CacheEntryInfo", "Consumer", "DataLoadMesh", "Dataset", "FingerprintProvider", "Loader", "ResumeStateError", "RuntimeContext", "TorchLoader", "UnsupportedResume",
    "clear_cache", "get_log_level", "get_logger", "list_cache_entries", "reset_log_level", "reset_logger", "set_log_level", "set_logger",
]
