"""Language-model steps behind one small protocol; deterministic rules and replayed replies need no network."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from factloom.operators.fold import Active, Row, Verdict, best_target


class TextModel(Protocol):
    def verdict(self, statement: Row, active: list[Row]) -> Verdict: ...

    def resolves(self, question: str, quote: str) -> bool: ...


_CHANGE = re.compile(r"\b(?:chang\w*|instead|no longer|now|replac\w*|switch\w*|increas\w*|decreas\w*|rais\w*|lower\w*|extend\w*|reduc\w*|move[sd]? to|from now on|actually|small change|updated?)\b", re.I)


@dataclass(frozen=True)
class RuleModel:
    """Rules of this engine: wording decides. No-change wording restates, change wording changes the best target, else new."""

    def verdict(self, statement: Row, active: list[Row]) -> Verdict:
        target = best_target(statement.words, active)
        if statement.no_change and target:
            return Verdict("DUPLICATE", target.ef_id, "wording")
        if target and _CHANGE.search(statement.quote):
            return Verdict("CHANGE", target.ef_id, "wording")
        return Verdict("NEW")

    def resolves(self, question: str, quote: str) -> bool:
        return False


@dataclass(frozen=True)
class ReplayModel:
    """Scripted verdicts by normalised quote: {norm: (verdict, target, reason)}; anything else is unclear."""

    verdicts: dict = field(default_factory=dict)
    answers: dict = field(default_factory=dict)

    def verdict(self, statement: Row, active: list[Row]) -> Verdict:
        v = self.verdicts.get(statement.norm)
        return checked(Verdict(*v), active) if v else Verdict("UNCLEAR")

    def resolves(self, question: str, quote: str) -> bool:
        return bool(self.answers.get((question, quote)))


def checked(v: Verdict, active: list[Row]) -> Verdict:
    """A change of an unknown target is unclear; a duplicate of one has no target."""
    held = active.by_id if isinstance(active, Active) else {f.ef_id for f in active}
    if v.target is not None and v.target not in held:
        return Verdict("UNCLEAR" if v.verdict == "CHANGE" else v.verdict, None, v.reason)
    return v


def parse_verdict(reply: str, active: list[Row]) -> Verdict:
    """VERDICT / TARGET / REASON lines; anything unreadable is unclear."""
    word = re.search(r"VERDICT:\s*(NEW|DUPLICATE|CHANGE|UNCLEAR)", reply, re.I)
    target = re.search(r"TARGET:\s*(?:EF-)?(\d+)", reply, re.I)
    reason = re.search(r"REASON:\s*(.+)", reply, re.I)
    if not word:
        return Verdict("UNCLEAR")
    v = Verdict(word.group(1).upper(), int(target.group(1)) if target else None, reason.group(1).strip() if reason else "")
    return Verdict("UNCLEAR", None, v.reason) if v.verdict == "CHANGE" and v.target is None else checked(v, active)


def strip_thinking(reply: str) -> str:
    """A reply without its thinking; what follows a dangling closing tag is the reply."""
    return re.sub(r"(?is)<think>.*?</think>", "", reply).rpartition("</think>")[2].strip()


def parse_blocks(reply: str, marker: str, labels: list[str]) -> list[dict]:
    """Blocks after each marker up to the next heading; the first value of each label counts, all labels are required."""
    out = []
    for block in re.split(rf"(?m)^\s*##\s*{re.escape(marker)}\s*$", reply)[1:]:
        block = re.split(r"(?m)^\s*##\s", block)[0]
        found = {}
        for label in labels:
            m = re.search(rf"(?mi)^\s*[-*]*\s*{label}\s*:\s*(.+?)\s*$", block)
            if m and m.group(1).strip():
                found[label.lower()] = m.group(1).strip()
        if len(found) == len(labels):
            out.append(found)
    return out


def parse_statements(reply: str) -> list[dict]:
    """Facts, then questions, of a reply with STATEMENT and OPEN_QUESTION blocks."""
    facts = [b | {"kind": "fact"} for b in parse_blocks(reply, "STATEMENT", ["Feature", "Summary", "Quote", "Speaker", "Timestamp"])]
    asked = [{("summary" if k == "question" else k): v for k, v in b.items()} | {"kind": "question"} for b in parse_blocks(reply, "OPEN_QUESTION", ["Feature", "Question", "Quote", "Speaker", "Timestamp"])]
    return facts + asked


def parse_areas(reply: str, n: int) -> dict[int, str]:
    """"<number> = <area>" lines for statements 1..n."""
    pairs = re.findall(r"(?m)^\s*(\d+)\s*[=.):-]+\s*(.+?)\s*$", reply)
    return {int(k): v for k, v in reversed(pairs) if 1 <= int(k) <= n}


def parse_gaps(reply: str, valid: set[int]) -> list[tuple[str, list[int]]]:
    """"GAP: question [from EF-n]" lines with references that exist."""
    out = []
    for q, refs in re.findall(r"(?mi)^\s*(?:[-*]\s*)?GAP:\s*(.+?)\s*\[(?:from\s*)?((?:EF-\d+[,\s]*)+)\]\s*$", reply):
        ids = [i for x in re.findall(r"EF-(\d+)", refs) if (i := int(x)) in valid]
        if ids:
            out.append((q.strip().rstrip(".?") + "?", ids))
    return out


def parse_merges(reply: str, names: list[str]) -> list[list[str]]:
    """"MERGE: a + b => a" lines; names may be given by number. The canonical name stands first."""
    by = {str(i + 1): n for i, n in enumerate(names)} | {n.lower(): n for n in names}
    out = []
    for left, right in re.findall(r"(?mi)^\s*MERGE:\s*(.+?)\s*=>\s*(.+?)\s*$", reply):
        members = [by[k] for x in left.split("+") if (k := x.strip().strip('"#').lower()) in by]
        head = by.get(right.strip().strip('"#').lower())
        if head and len(set(members) | {head}) > 1:
            out.append([head, *[m for m in dict.fromkeys(members) if m != head]])
    return out


# Messages of a serving process that are worth another try, and those of the network.
TRANSIENT = ("compute error", "500", "llama runner process has terminated", "failed to decode", "cuda error", "timed out", "connection reset", "connection refused", "temporarily", "502", "503", "504")


def with_retries(call: Callable[[], str], tries: int = 3, wait: float = 4.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Calls again after a transient failure, waiting twice as long each time; other failures go through at once."""
    for n in range(tries):
        try:
            return call()
        except (OSError, urllib.error.URLError) as e:
            if n + 1 == tries or not any(t in str(e).lower() for t in TRANSIENT):
                raise
            sleep(wait * 2**n)
    raise AssertionError


def join_stream(lines: list[str]) -> str:
    """The text of a streamed reply of JSON lines."""
    out = []
    for line in lines:
        if line.strip():
            part = json.loads(line)
            if part.get("error"):
                raise OSError(part["error"])
            out.append((part.get("message") or {}).get("content") or part.get("response") or "")
    return "".join(out)


@dataclass(frozen=True)
class HttpModel:
    """A chat endpoint that streams JSON lines. Its replies must be written to a table before they are used twice."""

    url: str
    name: str
    timeout: float = 600.0

    def chat(self, system: str, user: str, most_tokens: int = 700) -> str:
        body = json.dumps({"model": self.name, "stream": True, "options": {"temperature": 0, "num_predict": most_tokens}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}).encode()

        def call() -> str:
            req = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(req, timeout=self.timeout) as r:
                return join_stream(r.read().decode("utf-8", "replace").splitlines())

        return with_retries(call)

    def verdict(self, statement: Row, active: list[Row]) -> Verdict:
        facts = "\n".join(f"EF-{f.ef_id}: {f.summary} | {f.quote}" for f in active)
        return parse_verdict(self.chat("Compare a statement with recorded facts. Answer with the lines VERDICT (NEW, DUPLICATE, CHANGE or UNCLEAR), TARGET and REASON.", f"Facts:\n{facts}\n\nStatement: {statement.summary} | {statement.quote}", 200), active)

    def resolves(self, question: str, quote: str) -> bool:
        return self.chat("Answer YES or NO only.", f"Does the statement answer the question?\nQuestion: {question}\nStatement: {quote}", 5).strip().upper().startswith("YES")


def explain_error(error: Exception, name: str) -> str:
    text = str(error)
    return f"The model {name} isn't installed at the endpoint." if "not found" in text.lower() else f"The model call failed: {text}"


