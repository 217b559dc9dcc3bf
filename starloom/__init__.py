"""starloom: raw tables in, profiled / linked / star-schema model and
analytic tables out -- every step a Spark DataFrame plan.

Sub-packages
------------
sources    file and table loading, model persistence
functions  Column-expression helpers (name tokens, calendar, value parsing)
operators  the operators of the model builder (profile, overlap, link
           scoring, naming, strategy, build, graph checks, analytic tables,
           chart aggregates, enrichment candidates)
plans      end-to-end model building and the registered test queries
"""

from starloom.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
__version__ = "0.1.0"
