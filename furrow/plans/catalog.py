"""All registered queries of the library and their SQL."""

from __future__ import annotations

from functools import partial

from furrow.plans.areal import AREAL, AREAL_SQL
from furrow.plans.framed import FRAMED, ORACLES
from furrow.plans.ledger import LEDGER, LEDGER_SQL
from furrow.plans.ringed import RING_SQL, RINGED
from furrow.plans.shared import SHARED
from furrow.plans.views import run, standard


def queries() -> dict:
    return {**{name: partial(lambda spark, sf_dir, text: run(spark, sf_dir, text), text=text) for name, text in SHARED.items()}, **FRAMED, **RINGED, **AREAL, **LEDGER}


def oracle_sql() -> dict[str, str]:
    texts = {**{n: standard(t) for n, t in SHARED.items()}, **{n: standard(t) for n, t in {**ORACLES, **RING_SQL, **AREAL_SQL, **LEDGER_SQL}.items()}}
    # a recursive text says so once, at its beginning
    return {n: t.replace("RECURSIVE_HERE ", "").replace("WITH ", "WITH RECURSIVE ", 1) if "RECURSIVE_HERE" in t else t for n, t in texts.items()}
