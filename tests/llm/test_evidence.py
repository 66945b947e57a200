"""A document's toxicity rests on all its passages, not on the best one only."""

import math

import pytest

pytest.importorskip("palimpsest.llm")
from palimpsest.llm import toxicity  # noqa: E402


def test_evidence_counts_every_passage():
    model = toxicity.Model({"bad": 3.0}, lam=1.0, k=0.1, a=-4.0, b=1.0)
    score, gap = model.scorer(), " fine" * 50

    def evidence(passages):
        s, found = next(toxicity.scans(score, [" ".join(["bad" + gap] * passages + ["fine" + gap] * (60 - passages))]))
        return len(s), model.evidence([v for *_, v in found], len(s))

    n, one = evidence(1)
    e = 0.1 * n * math.exp(-3.0)
    assert one == pytest.approx(-math.log(1 - math.exp(-e)))
    # by chance there are about 15 such passages; 60 or more are a Poisson tail
    tail = sum(math.exp(-e + i * math.log(e) - math.lgamma(i + 1)) for i in range(60, 200))
    assert evidence(60)[1] == pytest.approx(-math.log(tail) - 2 * math.log(60))
    assert evidence(60)[1] > 20 > 1 > one
