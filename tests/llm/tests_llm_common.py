import importlib.util
from pathlib import Path

import pandas as pd

spec = importlib.util.spec_from_file_location("llm_conftest", Path(__file__).with_name("conftest.py"))
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
AWKWARD = module.AWKWARD


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    v = getattr(v, "item", lambda: v)()
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows_equal(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    key = lambda df: sorted(repr(tuple(map(plain, r))) for r in df[columns].itertuples(index=False, name=None))
    assert key(a) == key(b)
