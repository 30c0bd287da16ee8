"""Deterministic stand-in scorers for dry runs and tests.

A real deployment passes its own callable (a batch client of a chat
model) to ``score_rows``.  These stand-ins read the case line of a prompt
and answer from a threshold on one feature, sometimes wrapped in a
<think> section, so that every parsing path is exercised without a network.
"""

from __future__ import annotations

import re

_NEW_CASE = re.compile(r"(?:THIS child are:|this child are:)\s*\n+(.*?)(?:\n\n|$)", re.S)


def _value(prompt: str, name: str) -> float | None:
    m = _NEW_CASE.search(prompt)
    text = m.group(1) if m else prompt
    v = re.search(re.escape(name) + r" = (-?[0-9.]+(?:e[+-]?[0-9]+)?)", text)
    return float(v.group(1)) if v else None


def threshold_scorer(feature: str, threshold: float, above: str = "0", below: str = "1"):
    """Label by one feature of the NEW case; missing -> an unusable reply."""
    def score(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            v = _value(p, feature)
            if v is None:
                out.append("unsure")
            else:
                ans = above if v > threshold else below
                out.append(f"<think>{feature} is {v}</think> {ans}" if int(v) % 2 else ans)
        return out
    return score


def risk_scorer(feature: str, threshold: float):
    """Three flags from one feature of the NEW case."""
    def score(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            v = _value(p, feature)
            f = 1 if (v is not None and v > threshold) else 0
            out.append(f"y_diagnosis={f}; y_severity = {1 - f}; y_management={f}")
        return out
    return score
