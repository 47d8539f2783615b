"""Reading a language model's answer: which nodes it points to, and why."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

#: Fixed values.
KINDS, SEVERITIES, INTENTS = ("task", "artifact", "version"), ("info", "warn", "critical", "gold"), ("debug", "audit")
CUT_OFF = "The answer was cut off; these findings were complete."
UNREADABLE = "The answer could not be read."
_decoder = json.JSONDecoder()


@dataclass
class Answer:
    intent: str
    explanation: str
    findings: list[dict] = field(default_factory=list)

    def ids(self, kind: str) -> list[str]:
        return [f["id"] for f in self.findings if f["kind"] == kind]


def _finding(x: object, known: set[str]) -> dict | None:
    """A finding on a known node of a known kind, its severity info if it is none of the four."""
    if not isinstance(x, dict) or x.get("id") not in known or x.get("kind") not in KINDS:
        return None
    out = {"id": x["id"], "kind": x["kind"], "reason": str(x.get("reason") or ""), "severity": x["severity"] if x.get("severity") in SEVERITIES else "info"}
    return out | ({"verdict": str(x["verdict"])} if x.get("verdict") else {})


def _findings(items: list, known: set[str]) -> list[dict]:
    found: dict[str, dict] = {}
    for x in items:
        if (f := _finding(x, known)) and f["id"] not in found:
            found[f["id"]] = f
    return list(found.values())


def _whole_objects(text: str) -> list[dict]:
    """Objects of the highlights array that are complete, in an answer that isn't."""
    m = re.search(r'"highlights"\s*:\s*\[', text)
    out, at = [], m.end() if m else len(text)
    while (at := text.find("{", at)) >= 0:
        try:
            x, at = _decoder.raw_decode(text, at)
        except json.JSONDecodeError:
            break
        out.append(x)
        if not re.match(r"\s*,", text[at:]):
            break
    return out


def parse(text: str, known: set[str], intent: str = "debug") -> Answer:
    """The answer in `text`: JSON, bare or in a fence, whole or cut off; other prose is taken as it is."""
    body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text).strip()
    start = body.find("{")
    if start >= 0:
        try:
            x, _ = _decoder.raw_decode(body, start)
        except json.JSONDecodeError:
            x = None
        if isinstance(x, dict) and ({"highlights", "explanation", "intent"} & x.keys()):
            items = x.get("highlights")
            return Answer(x["intent"] if x.get("intent") in INTENTS else intent, str(x.get("explanation") or ""), _findings(items if isinstance(items, list) else [], known))
        if found := _findings(_whole_objects(body), known):
            said = re.search(r'"intent"\s*:\s*"(\w+)"', body)
            return Answer(said[1] if said and said[1] in INTENTS else intent, CUT_OFF, found)
    if body.startswith("{") or text.lstrip().startswith("```"):
        return Answer(intent, UNREADABLE)
    return Answer(intent, text.strip())


def merged(floor: list[str], more: list[str]) -> list[str]:
    """What was retrieved and what the model adds, each once, in the order first seen."""
    return list(dict.fromkeys([*floor, *more]))
