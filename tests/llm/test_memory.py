"""Freed memory of numpy passes is used again."""

from __future__ import annotations

import subprocess
import sys

FAULTS = """
import resource
import numpy as np
from marketloom.llm import arrow, attention
arrow.reuse()
model, rng = attention.Attention(), np.random.default_rng(1)
inputs, targets = rng.integers(0, 1024, (256, attention.SPAN)), rng.integers(0, 1024, (256, attention.STRIDE))
def step():
    model.log_probability(inputs, targets)
    model._gradients(inputs[:96], targets[:96])
for _ in range(3):
    step()
before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
for _ in range(20):
    step()
print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) / 20)
"""


def test_passes_of_the_attention_model_fault_no_pages_in_anew():
    out = subprocess.run([sys.executable, "-c", FAULTS], capture_output=True, text=True, check=True)
    assert float(out.stdout) < 100  # more than 5,000 without reuse
