"""A deterministic model function for offline use and tests.

It reads the context text of a prompt and answers in the JSON the stages
expect. Swap in a function that calls a real model for production use.
"""

from __future__ import annotations

import json
import re

import pandas as pd

from siltlog.plans.prompts import CLASSIFICATION_SYSTEM, TIMELINE_SYSTEM

# (text looked for in the lower-cased message, category, confidence); first hit wins.
MESSAGE_RULES = (
    ("forbidden", "Security", 90),
    ("nikto", "Security", 85),
    ("error state", "Service Instability", 80),
    ("workerenv.init", "Configuration", 88),
    ("found child", "Worker Initialization", 92),
    ("slow", "Performance", 75),
    ("status 404", "Resource Not Found", 95),
    ("status 403", "Security", 82),
    ("get /", "Request Processing", 70),
    ("post /", "Request Processing", 70),
)
LEVEL_RULES = {"error": ("Error", 60), "crit": ("Error", 65), "warn": ("Warning", 60)}
SEVERITY = {"crit": "critical", "error": "high", "warn": "medium", "notice": "info", "info": "info"}

_ENTRY = re.compile(r"^\[ID: (.*)\]\n  Level: (.*)\n  Message: (.*)$", re.M)
_HOUR = re.compile(r"^--- (\d{4}-\d{2}-\d{2}T\d{2}:00|unknown-time) ---$")
_GROUP = re.compile(r"^\[(\w+)\] (.*) \| Occurrences: (\d+) \|")


def category_of(level: str, message: str) -> tuple[str, int]:
    lowered = message.lower()
    for needle, category, confidence in MESSAGE_RULES:
        if needle in lowered:
            return category, confidence
    return LEVEL_RULES.get(level, ("Unknown", 30))


def _classify(prompt: str) -> list[dict]:
    answers = []
    for log_id, level, message in _ENTRY.findall(prompt):
        category, confidence = category_of(level, message)
        answers.append(
            {
                "id": log_id,
                "category": category,
                "confidence": confidence,
                "severity": SEVERITY.get(level, "low"),
                "explanation": f"{level} line",
                "insight": f"{category} activity",
            }
        )
    return answers


def _timeline(prompt: str) -> dict:
    section = prompt.split("=== ERROR/WARNING PATTERNS BY TIME WINDOW ===")[-1].split("\n===")[0]
    events: dict[str, list[str]] = {}
    hour = None
    for line in section.split("\n"):
        found = _HOUR.match(line)
        if found:
            hour = found.group(1)
        elif hour and line:
            events.setdefault(hour, []).append(line)
    return {
        "timeline": [
            {
                "timestamp": when if when != "unknown-time" else "",
                "eventTitle": f"{len(lines)} patterns",
                "severity": "error" if any(x.startswith(("[ERROR]", "[CRIT]")) for x in lines) else "info",
                "summary": lines[0],
                "escalationPath": [],
                "supportingEvidence": lines[:3],
                "affectedComponents": [],
            }
            for when, lines in events.items()
        ],
        "overallSummary": f"{len(events)} active hours",
    }


def _root_cause(prompt: str) -> dict:
    groups = [m.groups() for m in map(_GROUP.match, prompt.split("\n")) if m]
    if not groups:
        try:
            reports = json.loads(prompt[prompt.index("[") :])
        except ValueError:
            return {}
        groups = [
            ("ERROR", e["log_pattern"], str(e["occurrences"])) for r in reports for e in r["evidence"]
        ]
    worst = sorted(groups, key=lambda g: (g[0] != "ERROR", -int(g[2])))[:3]
    return {
        "rootCause": worst[0][1] if worst else "",
        "evidence": [
            {"finding": g[1], "logPattern": g[1], "occurrences": int(g[2]), "significance": g[0]} for g in worst
        ],
        "causalChain": [g[1] for g in worst],
        "impact": f"{len(groups)} patterns involved",
        "recommendations": [{"action": "Check the failing component", "priority": "high", "rationale": "Most frequent"}],
        "confidence": 50,
    }


def rule_model(requests: pd.DataFrame) -> pd.DataFrame:
    texts = []
    for system, prompt in zip(requests["system_prompt"], requests["user_prompt"]):
        if system == CLASSIFICATION_SYSTEM:
            answer = _classify(prompt)
        elif system == TIMELINE_SYSTEM:
            answer = _timeline(prompt)
        else:
            answer = _root_cause(prompt)
        texts.append(json.dumps(answer))
    sent = requests["system_prompt"].str.len() + requests["user_prompt"].str.len()
    got = pd.Series([len(t) for t in texts], index=requests.index)
    return requests.assign(
        text=texts,
        prompt_token_count=(sent + 3) // 4,
        candidates_token_count=(got + 3) // 4,
        total_token_count=(sent + 3) // 4 + (got + 3) // 4,
    )
