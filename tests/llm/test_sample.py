"""The bound on training texts."""

from __future__ import annotations

import inspect

from inkstone.llm import toxicity


def test_training_takes_1500_texts_of_a_class():
    assert toxicity.SAMPLE == 1500
    assert inspect.signature(toxicity.train).parameters["sample"].default == 1500
