"""Log-noise analytics on Spark: templates, bursts, suppression, notices and traces.

Every operator takes and returns a DataFrame; see README.md for the operator list.
"""

from hushlog.options import Options

__all__ = ["Options"]
