"""Query plans: small immutable documents made on the driver."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

# Limits of a plan.
MOST_TOP_K, MOST_VARIANTS, CONTEXT_ITEMS, TIMEOUT_MS = 100, 4, 16, 15_000
MOST_QUESTION, DIMENSIONS = 4_000, 512
LANES = ("dense", "lexical", "facts", "tables")
PERIOD = re.compile(r"\d{4}(?:-(?:Q[1-4]|H[12]|(?:0[1-9]|1[0-2])))?\Z")


class PlanError(ValueError):
    """A request that can't be planned; ``code`` says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def canonical_json(value: object) -> str:
    """Sorted keys, no blanks, ASCII only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def digest(value: object) -> str:
    return "sha256:" + hashlib.sha256(canonical_json(value).encode()).hexdigest()


def instant(text: str) -> datetime:
    """An ISO time with a zone, in UTC; a time without one is rejected, never guessed."""
    try:
        t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise PlanError("BAD_CUTOFF", text) from None
    if t.tzinfo is None:
        raise PlanError("NAIVE_CUTOFF", text)
    return t.astimezone(timezone.utc)


@dataclass(frozen=True)
class Budgets:
    lane: int
    fused: int
    context: int
    timeout_ms: int = TIMEOUT_MS

    @classmethod
    def of(cls, top_k: int) -> Budgets:
        return cls(top_k, top_k, min(top_k, CONTEXT_ITEMS))


@dataclass(frozen=True)
class Plan:
    question: str
    as_of: str
    lanes: tuple[str, ...]
    budgets: Budgets
    variants: tuple[str, ...]
    entities: tuple[str, ...] | None = None
    documents: tuple[str, ...] | None = None
    forms: tuple[str, ...] | None = None
    periods: tuple[str, ...] | None = None
    pins: dict[str, str] = field(default_factory=dict)

    def text(self) -> str:
        return canonical_json(asdict(self))

    def id(self) -> str:
        return digest(asdict(self))


def plan_query(question: str, as_of: str, workspace_as_of: str, lanes: list[str] | None = None, top_k: int = 50, synonyms: dict[str, str] | None = None, entities: list[str] | None = None, documents: list[str] | None = None, forms: list[str] | None = None, periods: list[str] | None = None, pins: dict[str, str] | None = None) -> Plan:
    """Checks a request and makes its plan. The earlier of both cutoffs counts; lanes keep the
    order asked for; an empty filter is no filter."""
    question = question.strip()
    if not question:
        raise PlanError("EMPTY_QUESTION")
    if len(question) > MOST_QUESTION:
        raise PlanError("QUESTION_TOO_LONG", str(len(question)))
    if not 1 <= top_k <= MOST_TOP_K:
        raise PlanError("BAD_TOP_K", str(top_k))
    asked = tuple(LANES if lanes is None else lanes)
    if not asked:
        raise PlanError("EMPTY_LANES")
    if set(asked) - set(LANES):
        raise PlanError("UNKNOWN_LANE", ",".join(sorted(set(asked) - set(LANES))))
    if len(set(asked)) < len(asked):
        raise PlanError("DUPLICATE_LANE", ",".join(asked))
    for p in periods or ():
        if not PERIOD.match(p):
            raise PlanError("BAD_PERIOD", p)
    cutoff = min(instant(as_of), instant(workspace_as_of))
    some = lambda x: tuple(dict.fromkeys(x)) if x else None
    variants = [question]
    for word, other in (synonyms or {}).items():
        variants.append(re.sub(rf"\b{re.escape(word)}\b", other, question, count=1, flags=re.I))
    return Plan(
        question, cutoff.strftime("%Y-%m-%dT%H:%M:%SZ"), asked, Budgets.of(top_k), tuple(dict.fromkeys(variants))[:MOST_VARIANTS],
        some(entities), some(documents), some(forms), some(periods), dict(pins or {}),
    )


def index_spec(corpus_version: str, provider: str, model: str, config: dict, dimensions: int = DIMENSIONS, metric: str = "cosine") -> dict:
    """Pins of an index: its identity is the hash of what it was made from."""
    if dimensions != DIMENSIONS:
        raise PlanError("BAD_DIMENSIONS", str(dimensions))
    if metric != "cosine":
        raise PlanError("BAD_METRIC", metric)
    pins = {"corpus_version": corpus_version, "provider": provider, "model": model, "dimensions": dimensions, "metric": metric, "config_hash": digest(config)}
    return pins | {"id": digest(pins)}
