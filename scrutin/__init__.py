"""scrutin: search, rank and cluster text evidence with Spark DataFrames.

Layout
- ``sources``    readers and writers: evidence records, stop lists, index tables
- ``functions``  column expressions and fixed values shared by operators
- ``operators``  one module per operator family (documents, analysis, query
                 clauses, ranking, hits, clustering, map analytics, bookmarks,
                 export)
- ``plans``      end-to-end jobs composed from operators (index, search, cluster)
- ``streaming``  incremental ingest with Structured Streaming
"""

__version__ = "0.1.7"


def _code_version() -> str:
    """Hash of the package sources: keys of cached tables in the shared folder
    include it, so a code change never reads tables built by older code."""
    import hashlib
    import os
    h = hashlib.md5(__version__.encode())
    root = os.path.dirname(os.path.abspath(__file__))
    for d, _, files in sorted(os.walk(root)):
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(d, f), "rb") as fh:
                    h.update(fh.read())
    return h.hexdigest()[:12]


CODE_VERSION = _code_version()


def _ship_by_value() -> None:
    """Python functions of this package run inside Spark tasks (Arrow batch
    kernels, small UDF helpers). Pickle them by value so executors do not
    need the package installed."""
    try:
        import sys

        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - pyspark missing or very old
        pass


_ship_by_value()
