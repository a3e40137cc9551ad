"""codeshift: Spark DataFrame operators that measure how automated rewrites change code.

Layers:

* ``codeshift.functions``  - Column -> Column expressions (line profile, distances,
  complexity, header parsing, whitespace handling).  All JVM-side except the
  run-based ``ndiff_distance`` (an Arrow pandas UDF).
* ``codeshift.operators``  - DataFrame -> DataFrame transforms (session building,
  pair extraction, record assembly, outcomes, column shaping, normalisation,
  reports).
* ``codeshift.sources`` / ``codeshift.sinks`` - file and table readers / writers.
* ``codeshift.folders`` - a file per session on a disk: written, listed and read by tasks.
* ``codeshift.plans``      - the three stages end to end plus the query catalog.
* ``codeshift.streaming``  - the stateless part of record building on a stream.
"""

__version__ = "0.1.0"
