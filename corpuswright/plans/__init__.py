"""All registered queries of the library: name -> (spark, folder of tables) -> DataFrame, and their SQL.

FIXTURES are queries over a few inline rows, which tests compare with their SQL; they read no table and are not registered.
"""

from . import checks, cjk_queries, induced, lookups, queries, retrieval, study, verse

_MODULES = (queries, induced, lookups, checks, study, retrieval, verse)
FIXTURES = {**cjk_queries.QUERIES, **{name: f for name, f in study.QUERIES.items() if name.startswith("cjk_")}}
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items() if name not in FIXTURES}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items() if name not in FIXTURES}
FIXTURE_SQL = {**cjk_queries.ORACLES, **{name: sql for name, sql in study.ORACLES.items() if name in FIXTURES}}
