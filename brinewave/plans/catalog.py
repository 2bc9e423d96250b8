"""Imports every query module so that the registry is complete."""

from brinewave.plans import train_queries  # noqa: F401
from brinewave.plans.registry import ENTRIES  # noqa: F401
from brinewave.plans import event_queries  # noqa: F401,E402
from brinewave.plans import source_queries  # noqa: F401,E402
from brinewave.plans import sample_queries  # noqa: F401,E402
from brinewave.plans import spectrum_queries  # noqa: F401,E402
from brinewave.plans import bearing_queries  # noqa: F401,E402
from brinewave.plans import signal_queries  # noqa: F401,E402
from brinewave.plans import live_queries  # noqa: F401,E402
from brinewave.plans import recording_queries  # noqa: F401,E402
