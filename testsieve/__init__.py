"""testsieve: corpus-scale analysis of Go unit tests on Apache Spark.

Source files are rows; functions, statements, calls, imports, loops, literals
and struct fields are fact tables derived with Spark SQL expressions; every
report is a join / window / aggregate over those facts.
"""

from testsieve.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
