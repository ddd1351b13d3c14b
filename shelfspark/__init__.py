"""shelfspark — product-catalog and sales analytics as PySpark DataFrame operators.

Every public operator takes DataFrames (plus plain parameters) and returns a
lazy DataFrame built from native Spark expressions, so Catalyst can push
filters into the scan, prune columns, and plan shuffles.
"""

from shelfspark.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
