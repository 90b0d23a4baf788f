"""tessera: topic analytics as plain Spark DataFrame functions.

Every operator is either a ``Column -> Column`` expression (``tessera.functions``)
or a ``DataFrame -> DataFrame`` function (``tessera.operators``); sources and sinks
live in ``tessera.sources``, Structured Streaming jobs in ``tessera.streaming`` and
the registered, oracle-checked queries in ``tessera.plans``.
"""

from tessera.session import get_session, ensure_conf, checkpoint_dir

__all__ = ["get_session", "ensure_conf", "checkpoint_dir"]
