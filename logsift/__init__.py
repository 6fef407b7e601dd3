"""logsift: log triage and failure analytics as Spark DataFrame operators.

Every public operator takes DataFrame(s) plus plain parameters and returns a
DataFrame.  No operator reads the wall clock, the environment or a module
cache: ``now`` and every tunable are explicit arguments.
"""

__version__ = "0.1.0"
