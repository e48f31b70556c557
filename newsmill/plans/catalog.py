"""All queries over the reference tables, by name, and their oracles."""

from newsmill.plans import answers, attribution, classify, clusters, lines, rails, similar, story, tables

MODULES = (tables, similar, classify, answers, story, rails, clusters, lines, attribution)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in MODULES for k, v in m.ORACLES.items()}
