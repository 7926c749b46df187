"""All queries of the library and the SQL that they are compared with."""

from __future__ import annotations

from inkwell.plans import citing, comparing, corpora, detecting, disguises, editing, extending, grammar_rules, images, joining, pairing, pieces, reading, reporting, reviewing, texts_and_statistics, unions
from inkwell.streaming import limits

PARTS = (comparing, texts_and_statistics, detecting, grammar_rules, citing, disguises, editing, corpora, reading, reporting, reviewing, images, joining, pairing, pieces, extending, unions, limits)

QUERIES: dict = {k: f for p in PARTS for k, f in p.QUERIES.items()}
ORACLES: dict = {k: s for p in PARTS for k, s in p.ORACLES.items()}
