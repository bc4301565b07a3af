"""memlake: agent-memory analytics as DataFrame-in / DataFrame-out operators on Spark.

Sub-packages: ``functions`` (column expressions), ``operators`` (relational
operators), ``sources`` (scans and sinks), ``plans`` (composed pipelines and the
query catalogue), ``streaming`` (Structured Streaming forms) and ``llm``
(training-data operators; nothing else imports it).
"""

__version__ = "0.1.0"
