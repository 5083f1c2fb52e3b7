"""A dialog per user as keyed streaming state: steps, expiry and an exact rate limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEPS = ("consent", "service", "name", "phone", "comment", "confirm")
OUTPUT = "user_id long, ts timestamp, outcome string, step string, answers map<string,string>"
STATE = "step string, answers string, updated double, accepted array<double>"


def _advance(step: str | None, answers: dict[str, str], updated: float, accepted: list[float], kind: str, payload: str, now: float, ttl: float, limit: int) -> tuple[str, str | None, dict[str, str], list[float]]:
    """Outcome, next step, answers and times of accepted requests after one event."""
    recent = [t for t in accepted if now - t < 3600]
    if step is not None and now - updated > ttl:
        step, answers = None, {}
    if kind == "forget":
        return "forgotten", None, {}, []
    if kind == "cancel":
        return ("cancelled" if step else "ignored"), None, {}, recent
    if kind == "start":
        return ("limited", None, {}, recent) if len(recent) >= limit else ("asked", STEPS[0], {}, recent)
    if step is None:
        return "ignored", None, {}, recent
    if not payload and step != "comment":
        return "invalid", step, answers, recent
    answers = {**answers, step: payload}
    if step != STEPS[-1]:
        return "asked", STEPS[STEPS.index(step) + 1], answers, recent
    if len(recent) >= limit:
        return "limited", None, {}, recent
    return "accepted", None, answers, [*recent, now]


def run_dialogs(events: DataFrame, ttl: float = 86_400.0, limit: int = 3) -> DataFrame:
    """Outcome of every event (user_id, ts, kind, payload) of a stream.

    Events of a user are taken in order of time within a micro-batch. Only accepted
    requests count towards the limit of an hour. A late event sees the newer state.
    """
    import json

    def handle(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, answers, updated, accepted = (None, {}, 0.0, [])
        if state.exists:
            step, packed, updated, accepted = state.get
            answers, accepted = json.loads(packed), list(accepted or [])
        rows = []
        for e in pd.concat(list(parts)).sort_values("ts", kind="stable").itertuples():
            now = e.ts.timestamp()
            outcome, step, after, accepted = _advance(step, answers, updated, accepted, e.kind, e.payload or "", now, ttl, limit)
            rows.append((key[0], e.ts, outcome, step, after))
            answers, updated = ({} if step is None else after), now
        state.update((step, json.dumps(answers), updated, accepted))
        yield pd.DataFrame(rows, columns=["user_id", "ts", "outcome", "step", "answers"])

    keyed = events.select("user_id", "ts", "kind", F.col("payload")).groupBy("user_id")
    return keyed.applyInPandasWithState(handle, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
