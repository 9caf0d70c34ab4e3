import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tapeline.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark(4, 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def bars(spark):
    """Two seeded random-walk symbols."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(7)
    out = []
    for sym, n in (("AAA", 420), ("BBB", 150)):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        o = c * np.exp(rng.normal(0, 0.005, n))
        out.append(pd.DataFrame({"symbol": sym, "ts": pd.date_range("2020-01-01", periods=n).date, "open": o, "high": np.maximum(o, c) * 1.01, "low": np.minimum(o, c) * 0.99,
                                 "close": c, "volume": rng.integers(100, 1000, n).astype(float)}))
    pdf = pd.concat(out)
    return spark.createDataFrame(pdf), pdf
