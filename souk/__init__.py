"""souk: marketplace analytics as Spark DataFrame operators.

Every operator is a plain function ``Tables -> DataFrame`` built from Spark
built-ins, so Catalyst sees one declarative plan per result.
"""

from souk.sources.tables import Tables, load_tables
from souk.plans.registry import OPERATORS, run

__all__ = ["Tables", "load_tables", "OPERATORS", "run"]
