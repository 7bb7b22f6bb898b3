"""The follow-the-regularised-leader step against one written out number by number."""

import math

import numpy as np
import pytest

from tarnlake.llm.quality_model import ALPHA, BETA, L1, L2, PLACES, Leader


def test_steps_by_hand():
    dice = np.random.default_rng(2)
    model, z, n = Leader(), {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= L1:
            return 0.0
        return -(z[i] - math.copysign(L1, z[i])) / ((BETA + math.sqrt(n[i])) / ALPHA + L2)

    for step in range(40):
        at = np.append(dice.choice(12, 5, replace=False), PLACES).astype(np.int32)
        x = np.append(dice.normal(0, 3, 5), 1.0)
        label = float(step % 3 == 0)
        model.learn(at, x, label)
        used = at.tolist()
        before = {i: weight(i) for i in used}
        chance = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(before[i] * v for i, v in zip(used, x))))))
        for i, v in zip(used, x):
            g = (chance - label) * v
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / ALPHA
            z[i] = z.get(i, 0.0) + g - sigma * before[i]
            n[i] = n.get(i, 0.0) + g * g
    keys = sorted(z)
    assert model.weights(np.array(keys)).tolist() == pytest.approx([weight(i) for i in keys])
    assert any(weight(i) for i in keys) and not model.weights(np.array([50]))[0]
