"""What the stored tables of an insights base leave on disk."""

from __future__ import annotations

import os

from registry import tables as t
from tillview.sources import star


def test_purchases_go_when_predictions_are_stored(spark, folder, monkeypatch):
    kept, made = [], star.shared_inputs
    monkeypatch.setattr(star, "shared_inputs", lambda *a: kept.append(made(*a)) or kept[-1])
    base = t.base(spark, folder)
    (bought, _), = kept
    assert not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in bought.inputFiles())
    assert base.count() > 0
