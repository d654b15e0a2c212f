"""Offline stand-ins for the model callables (small per-call Python helpers).

``rubric_model`` answers a triage prompt the way the rubric rules (J5) label
messages, as the JSON array the scoring contract expects; the native
``rubric_label`` operator computes the same verdicts without Python.
``lead_model`` and ``counting_model`` answer summary and synthesis prompts
deterministically; ``failing_model`` always raises, which exercises every
failure default.
"""

from __future__ import annotations

import json
import re

from sifter.config import DigestConfig
from sifter.operators.model_calls import PermanentError

_BLOCK = re.compile(r"--- Email (\d+) ---\nSubject: (.*?)\nFrom: (.*?)\nPreview: (.*?)\n---(?=\n--- Email \d+ ---\n|\Z)",
                    re.S)


def prompt_messages(prompt: str) -> list[tuple[str, str, str]]:
    """(subject, sender, preview) of every block of a triage prompt, in order."""
    return [(m.group(2), m.group(3), m.group(4)) for m in _BLOCK.finditer(prompt)]


def rubric_model(cfg: DigestConfig | None = None):
    from sifter.operators.triage import (RUBRIC_DISCARD_RULES, RUBRIC_GENERAL_SCORE, RUBRIC_HIGH_SCORE,
                                         topic_pattern)
    cfg = cfg or DigestConfig()
    rules = [(name, re.compile("(?i)(" + pat + ")")) for name, pat in RUBRIC_DISCARD_RULES]
    topical = re.compile(topic_pattern(cfg))

    def model(system: str, prompt: str) -> str:
        out = []
        for subject, sender, preview in prompt_messages(prompt):
            text = "\n".join([subject, sender, preview])
            rule = next((n for n, rx in rules if rx.search(text)), None)
            if rule is not None:
                out.append({"category": "discard", "relevance_score": 0.0, "topics": [], "reason": rule})
            elif topical.search(text):
                out.append({"category": "high_relevance", "relevance_score": RUBRIC_HIGH_SCORE, "topics": [],
                            "reason": "topic"})
            else:
                out.append({"category": "general_info", "relevance_score": RUBRIC_GENERAL_SCORE, "topics": [],
                            "reason": "editorial"})
        return json.dumps(out)

    return model


def lead_model(system: str, prompt: str) -> str:
    """Length and first words of a summary prompt's chunk; every seventh length has no answer."""
    chunk = prompt.split("\n\n", 1)[1]
    if len(chunk) % 7 == 0:
        raise PermanentError("no summary")
    return f"{len(chunk)} characters: {chunk[:40]}"


def counting_model(system: str, prompt: str) -> str:
    """What a synthesis prompt holds."""
    return f"## Digest\n{prompt.count('--- Item ---')} items, {len(prompt)} characters"


def failing_model(system: str, prompt: str) -> str:
    raise PermanentError("no model endpoint configured")
