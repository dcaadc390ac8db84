"""Policies as data against the reader of single policies."""

from __future__ import annotations

import json

import pytest
from sievework.operators import policy as P
from sievework.plans.policies import OVERLAYS, REFUSED


def test_overlays(spark):
    rows = [(k, json.dumps(v)) for k, v in OVERLAYS.items()] + [*REFUSED.items(), ("null", None), ("blank", "  "), ("part", '{"weights": null}'), ("huge", '{"weights": {"year": 1e999}}'), ("nested", '{"weights": {"year": {"a": 1}}}')]
    found = P.overlay(spark.createDataFrame(rows, "policy_id string, body string"))
    settings: dict = {}
    for r in found.settings.collect():
        settings.setdefault(r["policy_id"], {})[r["path"]] = r["value"]
    refused = {r["policy_id"] for r in found.problems.collect()}
    assert refused == {*REFUSED, "nested"} | ({"huge"} if "huge" not in settings else set())
    assert "huge" in refused
    for name, body in rows:
        if name in refused:
            with pytest.raises((ValueError, AttributeError)):
                P.load(text=body)
            continue
        text = body if body and body.strip() and name != "part" else "{}"
        one = P.load(text=text)
        want = {f"thresholds.{k}": v for k, v in one.thresholds.items()} | {f"weights.{k}": v for k, v in one.weights.items()} | {f"safety.{k}": float(v) for k, v in one.safety.items()}
        assert settings[name] == want
    versions = {r["policy_id"]: (r["version"], r["n_changed"]) for r in found.versions.collect()}
    assert versions["loose"] == ("loose-1", 2)
    assert versions["balanced"] == (f"{P.VERSION}-custom", 0)
