"""Flow analytics and intrusion detection expressed as Spark DataFrame plans."""

from flowlens.session import get_session

__all__ = ["get_session"]
__version__ = "0.1.0"
