"""Decoding invariants."""

import numpy as np
import pytest

from subjex.operators import decode as D
from subjex.plans import fixtures as fx
from testdata_paths import SF_SMALL


def test_decode_invariants(spark):
    p = fx.prob(spark, SF_SMALL)
    thr = [0.9] * 10
    rows = p.select("probs",
                    D.decode("probs", "threshold_ensure1", thr).alias("e1"),
                    D.decode("probs", "topk_minp", k=3, p_min=0.99).alias("mp"),
                    D.decode("probs", "topk", k=3).alias("k3"),
                    D.decode("probs", "topk", k=50).alias("k50"),
                    D.decode("probs", "topk", k=0).alias("k0"),
                    D.apply_thresholds_or_topk("probs", thr, 2).alias("u"),
                    D.argmax("probs").alias("am")).collect()
    for r in rows:
        probs = np.array(r["probs"])
        assert sum(r["e1"]) >= 1 and sum(r["mp"]) >= 1
        assert sum(r["k3"]) == 3 and sum(r["k50"]) == 10 and sum(r["k0"]) == 0
        assert sum(r["u"]) >= 2
        assert r["am"] == int(np.argmax(probs))
        top = set(np.argsort(-probs, kind="stable")[:3])
        assert {i for i, v in enumerate(r["k3"]) if v} == top


def test_unknown_mode_and_suffixes():
    with pytest.raises(ValueError):
        D.decode("probs", "nope")
    assert D.mode_suffix("threshold") == ""
    assert D.mode_suffix("threshold_ensure1") == "_thrEnsure1"
    assert D.mode_suffix("global", thr=0.7) == "_global0.70"
    assert D.mode_suffix("topk", k=3) == "_top3"
    assert D.mode_suffix("topk_minp", k=3, p_min=0.4) == "_top3_p0.40"
